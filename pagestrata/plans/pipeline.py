"""The ingest plan - validate, route, clean, extract, chunk, embed, append - and the search facade.

Ingest is one narrow plan: no shuffle, the html tree is built once per page. Documents without blocks
stay as failure rows because counts are taken before blocks are exploded.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata import __version__
from pagestrata.config import PipelineConfig, SearchConfig, SnapshotConfig, choose_config
from pagestrata.errors import SearchError, ValidationError, guarded
from pagestrata.functions.chunks import chunk_texts, chunked
from pagestrata.functions.html_tree import page_udf
from pagestrata.functions.text import clean_route, is_cyrillic
from pagestrata.functions.validate import Query, validated
from pagestrata.operators import export, stats
from pagestrata.operators.collection import Collection, nearest
from pagestrata.operators.embed import Embedder, embed_column, embedder_of
from pagestrata.operators.prune import Pruner, pruned, pruner_of
from pagestrata.plans.metrics import Metrics
from pagestrata.schemas import CAPTURE, CAPTURE_COLUMNS, DOCUMENT, RESULT
from pagestrata.session import stored
from pagestrata.sources import snapshots as sources


DEFAULTS = SearchConfig()


def as_documents(docs: DataFrame) -> DataFrame:
    """Documents with all columns the plan needs: url, capture and index may be absent."""
    for name, kind in (("url", "string"), ("wayback_metadata", CAPTURE), ("document_index", "bigint")):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    return docs.select("document_index", "html", "url", F.col("wayback_metadata").cast(CAPTURE).alias("wayback_metadata"))


def parsed_pages(docs: DataFrame, config: PipelineConfig, force_basic: bool = False, pruner: Pruner | None = None) -> DataFrame:
    """Valid documents with route, cleaned length and blocks; faulty ones with their error.

    Pages of the ai route go through ``pruner`` first; without one they are cleaned by the basic rules, as all others are.
    """
    docs = validated(as_documents(docs))
    route = clean_route(F.col("html"), F.col("wayback_metadata").isNotNull(), force_basic, config.prefer_basic_cleaning, config.cyrillic_detection_threshold)
    docs = docs.withColumn("route", route)
    page = page_udf(F.when(F.col("error").isNull(), pruned(F.col("html"), F.col("route.route"), pruner)))
    return docs.withColumn("page", page)


def result_rows(pages: DataFrame, config: PipelineConfig, dim: int, archived: bool = False) -> DataFrame:
    """One result row per document: counts, or what failed."""
    blocks = F.coalesce(F.size("page.blocks"), F.lit(0))
    texts = F.transform("page.blocks", lambda b: b["text"])
    size = config.max_chunk_size
    chunks = F.aggregate(F.transform(texts, lambda t: F.when(F.length(t) <= size, 1).otherwise(F.size(chunk_texts(t, size)))), F.lit(0), lambda a, b: a + b)
    chunks = F.coalesce(chunks, F.lit(0))
    error = F.coalesce(F.col("error"), F.when(blocks == 0, F.lit("No text blocks extracted")), F.when(chunks == 0, F.lit("No text chunks created")))
    ok = error.isNull()
    return pages.select(
        ok.alias("success"), "url", error.alias("error"), "document_index", F.length("html").cast("long").alias("original_html_length"), F.col("page.cleaned_length").alias("cleaned_html_length"), blocks.cast("long").alias("text_blocks_count"),
        chunks.cast("long").alias("chunked_blocks_count"), F.when(ok, chunks).otherwise(0).cast("long").alias("embedded_blocks_count"), F.when(ok, F.lit(dim)).alias("embedding_dimension"), F.when(ok & F.lit(archived), F.lit(True)).alias("wayback_processed"),
    ).select(*RESULT.names)


def block_rows(pages: DataFrame) -> DataFrame:
    """Text blocks of the pages with their url and capture columns."""
    capture = [F.col("wayback_metadata")[f].alias(c) for f, c in zip(("timestamp", "archive_url", "original_url", "domain", "title"), CAPTURE_COLUMNS)]
    exploded = pages.filter(F.col("error").isNull()).select("url", "wayback_metadata", F.explode("page.blocks").alias("b"))
    return exploded.select("b.text", "b.element_type", "b.hierarchy_level", "b.position", "url", *capture)


def embedded_blocks(blocks: DataFrame, embedder: Embedder) -> DataFrame:
    """Blocks with unit vectors."""
    return blocks.withColumn("embedding", embed_column(F.col("text"), embedder))


class Pipeline:
    """Ingest and search over one collection."""

    def __init__(self, spark: SparkSession, config: PipelineConfig | None = None, embedder: Embedder | None = None, pruner: Pruner | None = None, **changes):
        self.spark, self.config = spark, (config or PipelineConfig()).with_(**changes)
        self.embedder = embedder or embedder_of(self.config.embedding_model)
        self.pruner = pruner or pruner_of(self.config.html_pruner_model)
        self.collection = Collection(spark, self.config.collection_name, self.config.persist_directory)
        self.metrics = Metrics()

    @classmethod
    def create(cls, spark: SparkSession, preset: str | None = None, config_path: str | None = None, **changes) -> Pipeline:
        """A pipeline of a preset, else of a settings file, with changes."""
        return cls(spark, choose_config(preset, config_path, **changes))

    @guarded("html")
    def process_documents(self, docs: DataFrame | Sequence[Mapping], force_basic: bool = False, strict: bool = False, archived: bool = False) -> DataFrame:
        """Ingest documents and return one result row for each."""
        if not isinstance(docs, DataFrame):
            rows = [(i, d.get("html"), d.get("url"), d.get("wayback_metadata")) for i, d in enumerate(docs)]
            if not rows:
                raise ValidationError("no documents")
            names = "document_index bigint, html string, url string, wayback_metadata " + CAPTURE.simpleString()
            docs = self.spark.createDataFrame([(i, h, u, tuple((m or {}).get(f) for f in CAPTURE.names) if m is not None else None) for i, h, u, m in rows], names)
        if strict:
            validated(as_documents(docs), strict=True)
        with self.metrics.stage("ingest"):
            pages = stored(parsed_pages(docs, self.config, force_basic, self.pruner), "pages")
            self.collection.add(embedded_blocks(chunked(block_rows(pages), self.config.max_chunk_size), self.embedder))
            results = stored(result_rows(pages, self.config, self.embedder.dim, archived), "results")
        if self.config.enable_metrics:
            sums = stats.batch_summary(results).first()
            self.metrics.count("documents", sums["total"])
            self.metrics.count("failed", sums["failed"])
        return results

    def process_html(self, html: str, url: str, wayback_metadata: Mapping | None = None, force_basic: bool = False) -> dict:
        """Ingest one document."""
        return self.process_documents([{"html": html, "url": url, "wayback_metadata": wayback_metadata}], force_basic).first().asDict()

    @guarded("snapshot")
    def process_snapshots(self, directory: str, settings: SnapshotConfig | None = None, **changes) -> DataFrame:
        """Ingest a snapshot directory, filtered by domain, year and length."""
        settings = (settings or SnapshotConfig()).with_(**changes)
        report = sources.directory_report(self.spark, directory)
        if settings.require_metadata and not report["is_valid"]:
            raise ValidationError(report["error"] or "not a snapshot directory", directory=directory)
        docs = sources.filtered(sources.snapshots(self.spark, directory, settings.require_metadata), settings.domain_filters, settings.year_filters, settings.min_content_length)
        lenient = docs.withColumn("wayback_metadata", F.when(F.col("wayback_metadata.timestamp") != "unknown_timestamp", F.col("wayback_metadata")))
        return self.process_documents(lenient, settings.force_basic_cleaning, archived=True)

    @guarded("snapshot")
    def process_paths(self, directory: str, least: int = 100) -> DataFrame:
        """Ingest html files whose metadata stand in their paths."""
        return self.process_documents(sources.path_documents(self.spark, directory, least), True, archived=True)

    def search(self, query: str, n_results: int | None = None, where: Mapping | None = None, threshold: float | None = None) -> DataFrame:
        """The nearest chunks to a text; number and threshold default to the search settings."""
        n_results = DEFAULTS.default_n_results if n_results is None else n_results
        threshold = DEFAULTS.similarity_threshold if threshold is None else threshold
        q = Query(query, n_results, dict(where) if where else None, threshold)
        vector = self.embedder.encode([q.text])[0]
        return self.collection.search(vector.tolist(), q.n_results, q.where, q.threshold)

    def search_snapshots(self, query: str, n_results: int = 10, timestamp: str | None = None, domain: str | None = None, year: int | None = None) -> DataFrame:
        """Search among archived chunks of a timestamp, a domain and a year."""
        where: dict = {}
        if timestamp:
            where["wayback_timestamp"] = timestamp
        if domain:
            where["wayback_domain"] = domain
        if year:
            where["$and"] = [{"wayback_timestamp": {"$gte": f"{year}0101000000"}}, {"wayback_timestamp": {"$lt": f"{year + 1}0101000000"}}]
        return self.search(query, n_results, where)

    def search_ukrainian(self, query: str, n_results: int = 10) -> DataFrame:
        """Search among archived chunks whose text is mostly Cyrillic; an empty collection is an error."""
        if self.collection.rows().isEmpty():
            raise SearchError("the collection is empty", name=self.collection.name)
        vector = self.embedder.encode([Query(query, n_results).text])[0].tolist()
        rows = self.collection.rows().filter(is_cyrillic(F.col("text"), self.config.cyrillic_detection_threshold))
        return nearest(rows, vector, n_results).select("text", "metadata", "distance", "similarity_score", "id")

    def search_by_metadata(self, where: Mapping | None = None, limit: int | None = None) -> DataFrame:
        """Chunks that match a filter."""
        return self.collection.get(where, limit)

    def browse(self, domain: str | None = None, year: int | None = None, limit: int = 10) -> DataFrame:
        """Chunks of a domain or a year."""
        where: dict = {"wayback_domain": domain} if domain else {}
        if year:
            where["$and"] = [{"wayback_timestamp": {"$gte": f"{year}0101000000"}}, {"wayback_timestamp": {"$lt": f"{year + 1}0101000000"}}]
        return self.collection.get(where, limit)

    def database_stats(self, k: int = 10) -> dict:
        """Rows, domains and years of the collection, with the most frequent domains."""
        rows = self.collection.rows()
        counts = stats.distinct_counts(rows).first()
        domains = stats.top(stats.domain_histogram(rows), "domain", k).collect()
        years = [r["year"] for r in stats.year_histogram(rows).orderBy("year").select("year").collect()]
        return {"documents": rows.count(), "domains": counts["domains"], "years": years, "top_domains": {r["domain"]: r["count"] for r in domains}}

    def stats(self) -> dict:
        """Collection, model, settings and metrics."""
        return {"collection": self.collection.stats(), "model": self.embedder.info(), "config": self.config.as_dict(), "metrics": self.metrics.summary(), "version": __version__}

    def export(self, path: str, form: str = "json", sharded: bool = False) -> None:
        """Write the collection as JSON or CSV."""
        (export.export_sharded if sharded else export.export_file)(self.collection.get(), path, form)

    def validate_directory(self, directory: str) -> dict:
        """The report on a snapshot directory."""
        return sources.directory_report(self.spark, directory)

    def reset(self) -> None:
        """Empty the collection."""
        self.collection.reset()

    def load_models(self) -> dict:
        """Warm the embedder."""
        self.embedder.encode(["warm"])
        return self.embedder.info()

    def cleanup(self) -> None:
        """Release what is cached."""
        self.spark.catalog.clearCache()


__all__ = ["DEFAULTS", "DOCUMENT", "Pipeline"]
