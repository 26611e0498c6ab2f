"""The queries of the core by name, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions import html_tree, stamps, text, validate
from pagestrata.functions.chunks import chunked
from pagestrata.functions.vectors import cosine, literal
from pagestrata.operators import collection, snapshot_diff, stats
from pagestrata.operators.embed import HashedNgrams, embed_column
from pagestrata.operators.where import compile_where
from pagestrata.config import PipelineConfig
from pagestrata.plans.pipeline import block_rows, parsed_pages, result_rows
from pagestrata.schemas import CAPTURE, STORED
from pagestrata.session import shared_dir, table
from pagestrata.sources import snapshots
from pagestrata.streaming.ingest import windowed_counts


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector with the least id: the query of the search queries."""
    row = table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()
    return list(row["embedding"]) if row else []


def _nearest(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    q = _probe(spark, sf_dir)
    return collection.nearest(rows, q, 10, id_col="vec_id").select("vec_id", F.round("distance", 6).alias("distance"), F.round("similarity_score", 6).alias("similarity_score"))


def knn_top10_l2(spark, sf_dir):
    """The ten nearest vectors with distance and score."""
    return _nearest(spark, sf_dir, table(spark, sf_dir, "embeddings"))


def knn_top10_threshold(spark, sf_dir):
    """A threshold applied after the top ten of the mean of three vectors: some hits stay, some go."""
    rows = table(spark, sf_dir, "embeddings")
    three = [r["embedding"] for r in rows.orderBy("vec_id").select("embedding").limit(3).collect()]
    q = [sum(map(float, x)) / len(three) for x in zip(*three)]
    hits = collection.above(collection.nearest(rows, q, 10, id_col="vec_id"), 0.1)
    return hits.select("vec_id", F.round("distance", 5).alias("distance"))


def knn_filtered(spark, sf_dir):
    """The ten nearest vectors of one label: the filter comes before the search."""
    return _nearest(spark, sf_dir, table(spark, sf_dir, "embeddings").filter("label = 1"))


def cosine_all(spark, sf_dir):
    """Cosine of every vector to one."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(cosine(F.col("embedding"), literal(_probe(spark, sf_dir))), 6).alias("cosine"))


def dimension_check(spark, sf_dir):
    """Stored vectors by whether they have 64 components."""
    ok = validate.dimension_valid(F.col("embedding"), 64)
    return table(spark, sf_dir, "stored_record").groupBy(ok.alias("fits")).agg(F.count("*").alias("n"))


def cyrillic_share(spark, sf_dir):
    """Script share of every page and whether it counts as Cyrillic."""
    pages = table(spark, sf_dir, "html_document")
    return pages.select("page_id", F.round(text.cyrillic_share(F.col("html")), 6).alias("share"), text.is_cyrillic(F.col("html"), 0.2).alias("cyrillic"))


def clean_routes(spark, sf_dir):
    """Cleaning route and reason of every page."""
    pages = table(spark, sf_dir, "html_document")
    return pages.select("page_id", text.clean_route(F.col("html"), F.col("wayback_metadata").isNotNull()).alias("r")).select("page_id", "r.route", "r.reason")


def html_validity(spark, sf_dir):
    """Validity of every page's html."""
    return table(spark, sf_dir, "html_document").select("page_id", validate.html_valid(F.col("html")).alias("valid"))


def url_normalise(spark, sf_dir):
    """Normalised urls of captures, blocks and bare names."""
    urls = table(spark, sf_dir, "snapshot_meta").select("original_url").unionAll(table(spark, sf_dir, "documents").select("source"))
    return urls.distinct().select(F.col("original_url").alias("given"), validate.url_normal(F.col("original_url")).alias("url"))


def document_errors(spark, sf_dir):
    """Errors of documents by kind."""
    docs = validate.validated(table(spark, sf_dir, "html_document").select("html", "url", "wayback_metadata"))
    return docs.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


def block_validity(spark, sf_dir):
    """Errors of text blocks by kind."""
    blocks = table(spark, sf_dir, "text_block")
    return blocks.groupBy(F.coalesce(validate.block_error(blocks), F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


def page_titles(spark, sf_dir):
    """Titles of pages by a pattern."""
    return table(spark, sf_dir, "html_document").select("page_id", html_tree.title_by_pattern(F.col("html")).alias("title"))


def stamp_validity(spark, sf_dir):
    """Captures by whether their timestamp is valid."""
    return table(spark, sf_dir, "snapshot_meta").select("meta_id", stamps.stamp_valid(F.col("timestamp")).alias("valid"))


def stamp_parts(spark, sf_dir):
    """Parts of the timestamps of captures."""
    parts = stamps.stamp_parts(F.col("timestamp"))
    return table(spark, sf_dir, "snapshot_meta").select("timestamp").distinct().select(parts.alias("p")).select("p.*")


def domain_counts(spark, sf_dir):
    """Captures by domain."""
    return stats.histogram(table(spark, sf_dir, "snapshot_meta"), F.col("domain"), "domain")


def top_domains(spark, sf_dir):
    """The ten domains with most blocks."""
    return stats.top(stats.histogram(table(spark, sf_dir, "text_block"), F.col("wayback_domain"), "domain"), "domain")


def year_counts(spark, sf_dir):
    """Stored records by year of capture."""
    return stats.year_histogram(table(spark, sf_dir, "stored_record"))


def distinct_sites(spark, sf_dir):
    """Number of domains and years of the stored records."""
    return stats.distinct_counts(table(spark, sf_dir, "stored_record"))


def snapshot_filter(spark, sf_dir):
    """Captures of one site in two years with a least content length."""
    meta = table(spark, sf_dir, "snapshot_meta")
    docs = meta.select("meta_id", "content_length", F.struct("timestamp", "domain").alias("wayback_metadata"))
    return snapshots.filtered(docs, ["vilna-hromada.example", "www.vilna-hromada.example"], [2017, 2018], 20_000).select("meta_id", "content_length")


def metadata_filter(spark, sf_dir):
    """Stored records by a filter with equality, order, membership and alternatives."""
    rows = table(spark, sf_dir, "stored_record").select("id", "metadata")
    for c in ("url", "element_type", "wayback_timestamp", "wayback_domain"):
        rows = rows.withColumn(c, F.col("metadata")[c])
    where = {"element_type": {"$in": ["heading", "list_item"]}, "$or": [{"wayback_timestamp": {"$gte": "20180101000000"}}, {"element_type": "heading"}]}
    return rows.filter(compile_where(where)).select("id", "element_type", "wayback_timestamp").distinct()


def pairs_report(spark, sf_dir):
    """Pages and captures joined on their url: pairs and orphans of both kinds."""
    pages = table(spark, sf_dir, "html_document").select(F.col("url").alias("key")).filter("key IS NOT NULL").distinct()
    metas = table(spark, sf_dir, "text_block").select(F.col("url").alias("key")).filter("key IS NOT NULL").distinct()
    return snapshots.pair_report(pages, metas).select("total_html_files", "total_meta_files", "paired_files", "orphaned_html", "orphaned_meta", "is_valid")


def file_metadata(spark, sf_dir):
    """Capture fields derived from file names."""
    files = table(spark, sf_dir, "snapshot_meta").select("file_path").distinct().withColumn("name", F.element_at(F.split("file_path", "/"), -1))
    m = snapshots.synthetic_metadata(F.col("file_path"), F.col("name"))
    return files.select("file_path", m.alias("m")).select("file_path", "m.timestamp", "m.domain", "m.original_url")


def path_fields(spark, sf_dir):
    """Capture fields derived from paths."""
    files = table(spark, sf_dir, "snapshot_meta").select("file_path").distinct()
    return files.select("file_path", snapshots.path_metadata(F.col("file_path")).alias("m")).select("file_path", "m.timestamp", "m.year")


def processing_stats(spark, sf_dir):
    """Documents with and without text."""
    docs = table(spark, sf_dir, "documents")
    return stats.processing_stats(docs, ~text.is_blank(F.col("text")))


def length_stats(spark, sf_dir):
    """Number, length and average of texts by language."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") >= 100)
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


def shortened(spark, sf_dir):
    """Texts of blocks cut for display."""
    return table(spark, sf_dir, "text_block").select("block_id", text.shorten(F.col("text"), 100).alias("shown")).distinct()


def squeezed(spark, sf_dir):
    """Texts with runs of blanks as one space."""
    return table(spark, sf_dir, "text_block").select("block_id", text.squeeze(F.col("text")).alias("text")).distinct()


def _collection(spark: SparkSession, sf_dir: str) -> collection.Collection:
    """The stored records as a collection in the shared folder: one append of all records."""
    held = collection.Collection(spark, "stored", f"{shared_dir(spark).rstrip('/')}/collection-{uuid.uuid4().hex}")
    held._add_part(_stored_form(table(spark, sf_dir, "stored_record").dropDuplicates(["id"])), False)
    return held


def _stored_form(rows: DataFrame) -> DataFrame:
    given = {"id", "text", "embedding", "metadata"}
    return rows.select(*[F.col(f.name) if f.name in given else F.col("metadata")[f.name].try_cast(f.dataType).alias(f.name) for f in STORED.fields])


def store_update(spark, sf_dir):
    """A collection after two updates by id: headings get a mark, then those on position 1 another."""
    held = _collection(spark, sf_dir)
    mark = lambda where, m: held.rows().filter(where).withColumn("text", F.concat(F.lit(m), "text"))
    held.update(mark("element_type = 'heading'", "# "))
    held.update(mark("element_type = 'heading' AND position = 1", "! "))
    return held.rows().select("id", "text", "element_type")


def metadata_get(spark, sf_dir):
    """The first twenty texts of a collection that match a filter, by id."""
    return _collection(spark, sf_dir).get({"element_type": "list_item"}, 20).select("text", F.col("metadata")["element_type"].alias("element_type"))


def collection_search(spark, sf_dir):
    """The ten records of a collection nearest to the one with the least id, among paragraphs."""
    held = _collection(spark, sf_dir)
    first = table(spark, sf_dir, "stored_record").filter(F.size("embedding") == 64).orderBy("id").select("embedding").first()
    return held.search(list(first["embedding"]), 10, {"element_type": "paragraph"}).select("id", F.round("distance", 4).alias("distance"))


def url_formats(spark, sf_dir):
    """Urls of captures, blocks and bare names with their form or error."""
    urls = table(spark, sf_dir, "snapshot_meta").select("original_url").unionAll(table(spark, sf_dir, "documents").select("source")).distinct()
    return urls.select(F.col("original_url").alias("given"), validate.url_format(F.col("original_url")).alias("f")).select("given", "f.url", "f.error")


def orphan_names(spark, sf_dir):
    """Names of pages without blocks and of blocks without pages."""
    pages = table(spark, sf_dir, "html_document").select(F.col("url").alias("key")).filter("key IS NOT NULL").distinct()
    metas = table(spark, sf_dir, "text_block").select(F.col("url").alias("key")).filter("key IS NOT NULL").distinct()
    return snapshots.orphan_names(pages, metas).groupBy("name", "kind").agg(F.count("*").alias("n"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("html"), "url", F.lit(None).cast(CAPTURE).alias("wayback_metadata"))
    return validate.validated(docs).select(F.col("error").isNull().alias("success"), "url", "error")


def validation_summary(spark, sf_dir):
    """Summary of a batch of plain texts offered as html."""
    return stats.batch_summary(_checked(spark, sf_dir))


def validation_failures(spark, sf_dir):
    """Errors of a batch of plain texts offered as html."""
    return stats.failures(_checked(spark, sf_dir)).groupBy("error").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))


def tree_titles(spark, sf_dir):
    """Titles of pages by their tree."""
    return table(spark, sf_dir, "html_document").select("page_id", html_tree.title_udf(F.col("html")).alias("title"))


def event_slides(spark, sf_dir):
    """Events by sliding windows of two days and type."""
    return windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "2 days", "1 day").select("window_start", "event_type", "count")


def event_windows(spark, sf_dir):
    """Events by day and type."""
    return windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 day").select("window_start", "event_type", "count")


def html_blocks(spark, sf_dir):
    """Typed text blocks of every page."""
    pages = table(spark, sf_dir, "html_document").select("html", "url", "wayback_metadata")
    return block_rows(parsed_pages(pages, PipelineConfig()))


def block_kinds(spark, sf_dir):
    """Blocks of all pages by kind."""
    return html_blocks(spark, sf_dir).groupBy("element_type").agg(F.count("*").alias("n"))


def chunks(spark, sf_dir):
    """Chunks of the documents."""
    return chunked(table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text"), 512)


def ingest_results(spark, sf_dir):
    """One result row for each page."""
    pages = table(spark, sf_dir, "html_document").select("html", "url", "wayback_metadata")
    return result_rows(parsed_pages(pages, PipelineConfig()), PipelineConfig(), HashedNgrams().dim)


def ingest_summary(spark, sf_dir):
    """Successes and failures of ingest."""
    return stats.batch_summary(ingest_results(spark, sf_dir))


def corpus_summary(spark, sf_dir):
    """Sums and ratios of ingest."""
    return stats.corpus_stats(ingest_results(spark, sf_dir))


def embedded_blocks(spark, sf_dir):
    """Blocks with vectors of the default embedder."""
    return table(spark, sf_dir, "text_block").select("block_id", embed_column(F.col("text"), HashedNgrams(64)).alias("embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every core query as (spark, sf_dir) -> DataFrame."""
    found = (
        knn_top10_l2, knn_top10_threshold, knn_filtered, cosine_all, dimension_check, cyrillic_share, clean_routes, html_validity, url_normalise, document_errors, block_validity, page_titles, stamp_validity, stamp_parts,
        domain_counts, top_domains, year_counts, distinct_sites, snapshot_filter, metadata_filter, pairs_report, file_metadata, path_fields, processing_stats, length_stats, shortened, squeezed, store_update, event_windows, html_blocks,
        block_kinds, chunks, ingest_results, ingest_summary, corpus_summary, embedded_blocks, metadata_get, collection_search, url_formats, orphan_names, validation_summary, validation_failures, tree_titles, event_slides,
    )
    return {"p6_found": snapshot_diff.p6_found, **{f.__name__: f for f in found}}


_DISTANCE = "list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def _knn(where: str = "", outer: str = "") -> str:
    return f"""
        WITH near AS (
            SELECT vec_id, d FROM (SELECT vec_id, {_DISTANCE} AS d FROM embeddings {where}) ORDER BY d, vec_id LIMIT 10
        )
        SELECT vec_id, round(d, 6) AS distance, round(1 - d, 6) AS similarity_score FROM near {outer}
    """


_VALID_STAMP = r"""coalesce(regexp_matches(timestamp, '^[0-9]{14}$') AND TRY_CAST(substr(timestamp, 1, 4) AS INT) BETWEEN 1990 AND 2030 AND TRY_CAST(substr(timestamp, 5, 2) AS INT) BETWEEN 1 AND 12
    AND TRY_CAST(substr(timestamp, 7, 2) AS INT) BETWEEN 1 AND 31 AND TRY_CAST(substr(timestamp, 9, 2) AS INT) <= 23 AND TRY_CAST(substr(timestamp, 11, 2) AS INT) <= 59 AND TRY_CAST(substr(timestamp, 13, 2) AS INT) <= 59, false)"""
_CYR = r"len(regexp_extract_all(substr(html, 1, 2000), '[\x{0400}-\x{04FF}]'))"
_LAT = r"len(regexp_extract_all(substr(html, 1, 2000), '[A-Za-z\x{0130}\x{212A}]'))"
_IS_CYR = f"coalesce({_CYR} / nullif({_CYR} + {_LAT}, 0) > 0.2, false)"
_BLANK = r"[\s\x{0B}\x{1c}-\x{1f}\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_HTML_OK = r"(NOT regexp_matches(html, '^\s*$') AND regexp_matches(lower(html), '<(html|body|div|p|h[123])'))"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the core queries that SQL can express."""
    return {
        "p6_found": snapshot_diff.P6_SQL,
        "knn_top10_l2": _knn(),
        "knn_top10_threshold": """
            WITH q AS (SELECT i, sum(x) / 3 AS x FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 3)) GROUP BY i),
            v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
            near AS (SELECT vec_id, sum((v.x - q.x) * (v.x - q.x)) AS d FROM v JOIN q USING (i) GROUP BY vec_id ORDER BY d, vec_id LIMIT 10)
            SELECT vec_id, round(d, 5) AS distance FROM near WHERE 1 - d >= 0.1
        """,
        "knn_filtered": _knn("WHERE label = 1"),
        "cosine_all": "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS cosine FROM embeddings",
        "dimension_check": "SELECT coalesce(len(embedding) = 64, false) AS fits, count(*) AS n FROM stored_record GROUP BY 1",
        "cyrillic_share": f"SELECT page_id, round({_CYR} / nullif({_CYR} + {_LAT}, 0), 6) AS share, {_IS_CYR} AS cyrillic FROM html_document",
        "clean_routes": f"""SELECT page_id, CASE WHEN wayback_metadata IS NOT NULL OR {_IS_CYR} THEN 'basic' ELSE 'ai' END AS route,
            CASE WHEN wayback_metadata IS NOT NULL THEN 'archived' WHEN {_IS_CYR} THEN 'cyrillic' ELSE 'default' END AS reason FROM html_document""",
        "html_validity": f"SELECT page_id, coalesce({_HTML_OK}, false) AS valid FROM html_document",
        "url_normalise": """WITH urls AS (SELECT original_url AS given FROM snapshot_meta UNION SELECT source FROM documents)
            SELECT given, CASE WHEN regexp_matches(given, '^(http|https|file)://') THEN given WHEN given = '' THEN NULL
                WHEN NOT regexp_matches(given, '^[a-zA-Z][a-zA-Z0-9+.-]*:') AND NOT starts_with(given, '/') AND NOT contains(given, '.') THEN 'document://' || given ELSE given END AS url FROM urls""",
        "document_errors": f"""WITH d AS (SELECT html, url, wayback_metadata AS m, wayback_metadata.timestamp AS timestamp FROM html_document)
            SELECT coalesce(CASE WHEN html IS NULL OR regexp_matches(html, '^\\s*$') THEN 'HTML content is empty' WHEN NOT {_HTML_OK} THEN 'no HTML tags found' WHEN coalesce(url, '') = '' THEN 'URL is empty'
                WHEN m IS NOT NULL AND NOT {_VALID_STAMP} THEN 'invalid capture timestamp' WHEN m IS NOT NULL AND m.original_url IS NULL THEN 'capture has no original url' END, 'none') AS error, count(*) AS n FROM d GROUP BY 1""",
        "block_validity": r"""WITH b AS (SELECT *, regexp_replace(text, '^[\s\x{0B}\x{1c}-\x{1f}\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0B}\x{1c}-\x{1f}\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g') AS t FROM text_block)
            SELECT CASE WHEN coalesce(t, '') = '' THEN 'text is empty' WHEN length(t) > 100000 THEN 'text is too long'
                WHEN NOT coalesce(element_type IN ('heading', 'paragraph', 'list_item', 'table_cell', 'table_header', 'quote', 'division', 'span', 'text'), false) THEN 'unknown element type'
                WHEN NOT coalesce(hierarchy_level, 1) BETWEEN 1 AND 6 THEN 'level out of range' WHEN NOT coalesce(position >= 1, false) THEN 'position out of range' ELSE 'none' END AS error, count(*) AS n FROM b GROUP BY 1""",
        "page_titles": r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM html_document",
        "stamp_validity": f"SELECT meta_id, {_VALID_STAMP} AS valid FROM snapshot_meta",
        "stamp_parts": r"""WITH t AS (SELECT DISTINCT timestamp FROM snapshot_meta), p AS (SELECT timestamp, CASE WHEN regexp_matches(timestamp, '^[0-9]{14}$') THEN try_strptime(timestamp, '%Y%m%d%H%M%S') END AS d FROM t)
            SELECT timestamp, strftime(d, '%Y-%m-%dT%H:%M:%S') AS datetime, year(d)::INT AS year, month(d)::INT AS month, day(d)::INT AS day, hour(d)::INT AS hour, minute(d)::INT AS minute, second(d)::INT AS second, dayname(d) AS weekday,
                strftime(d, '%Y-%m-%d %H:%M:%S') || ' UTC' AS human_readable,
                CASE WHEN timestamp IS NULL OR length(timestamp) <> 14 THEN 'Invalid timestamp format' WHEN d IS NULL THEN 'Failed to parse timestamp' END AS error FROM p""",
        "domain_counts": "SELECT coalesce(domain, 'unknown') AS domain, count(*) AS count FROM snapshot_meta GROUP BY 1",
        "top_domains": "SELECT coalesce(wayback_domain, 'unknown') AS domain, count(*) AS count FROM text_block GROUP BY 1 ORDER BY count DESC, domain LIMIT 10",
        "year_counts": "SELECT coalesce(substr(metadata['wayback_timestamp'], 1, 4), 'unknown') AS year, count(*) AS count FROM stored_record GROUP BY 1",
        "distinct_sites": "SELECT count(DISTINCT coalesce(metadata['wayback_domain'], 'unknown')) AS domains, count(DISTINCT substr(metadata['wayback_timestamp'], 1, 4)) AS years FROM stored_record",
        "snapshot_filter": "SELECT meta_id, content_length FROM snapshot_meta WHERE domain IN ('vilna-hromada.example', 'www.vilna-hromada.example') AND TRY_CAST(substr(timestamp, 1, 4) AS INT) IN (2017, 2018) AND coalesce(content_length, 0) >= 20000",
        "metadata_filter": """SELECT DISTINCT id, metadata['element_type'] AS element_type, metadata['wayback_timestamp'] AS wayback_timestamp FROM stored_record
            WHERE metadata['element_type'] IN ('heading', 'list_item') AND (metadata['wayback_timestamp'] >= '20180101000000' OR metadata['element_type'] = 'heading')""",
        "pairs_report": """WITH h AS (SELECT DISTINCT url FROM html_document WHERE url IS NOT NULL), m AS (SELECT DISTINCT url FROM text_block WHERE url IS NOT NULL), b AS (SELECT h.url AS hu, m.url AS mu FROM h FULL JOIN m ON h.url = m.url)
            SELECT count(hu) AS total_html_files, count(mu) AS total_meta_files, count(*) FILTER (hu IS NOT NULL AND mu IS NOT NULL) AS paired_files, count(*) FILTER (mu IS NULL) AS orphaned_html, count(*) FILTER (hu IS NULL) AS orphaned_meta,
                count(*) FILTER (hu IS NOT NULL AND mu IS NOT NULL) > 0 AS is_valid FROM b""",
        "file_metadata": r"""WITH f AS (SELECT DISTINCT file_path, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\.[^.]*$', '') AS stem, regexp_extract(file_path, '^.*/(\d{14})/', 1) AS ts FROM snapshot_meta)
            SELECT file_path, CASE WHEN ts = '' THEN 'unknown_timestamp' ELSE ts END AS timestamp, CASE WHEN contains(stem, '_') THEN replace(split_part(stem, '_', 1), '-', '.') ELSE 'unknown_domain' END AS domain,
                CASE WHEN contains(stem, '_') THEN 'https://' || replace(split_part(stem, '_', 1), '-', '.') || '/' ELSE 'unknown_url_' || stem END AS original_url FROM f WHERE file_path IS NOT NULL
            UNION ALL SELECT DISTINCT file_path, NULL, NULL, NULL FROM snapshot_meta WHERE file_path IS NULL""",
        "processing_stats": r"""SELECT count(*) FILTER (ok) AS processed, count(*) FILTER (NOT ok) AS errors, count(*) AS total, coalesce(count(*) FILTER (ok) * 100.0 / nullif(count(*), 0), 0)::DOUBLE AS success_rate
            FROM (SELECT coalesce(NOT regexp_matches(text, '^[\s\x{0B}\x{1c}-\x{1f}\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*$'), false) AS ok FROM documents)""",
        "length_stats": "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 4) AS mean_chars FROM documents WHERE length(text) >= 100 GROUP BY lang",
        "shortened": "SELECT DISTINCT block_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS shown FROM text_block",
        "squeezed": r"SELECT DISTINCT block_id, trim(regexp_replace(text, '[\s\x{0B}\x{1c}-\x{1f}\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS text FROM text_block",
        "store_update": """SELECT id, CASE WHEN kind = 'heading' AND position = '1' THEN '! # ' || text WHEN kind = 'heading' THEN '# ' || text ELSE text END AS text, kind AS element_type
            FROM (SELECT DISTINCT id, text, metadata['element_type'] AS kind, metadata['position'] AS position FROM stored_record)""",
        "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS count FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
        "metadata_get": "SELECT text, 'list_item' AS element_type FROM (SELECT DISTINCT id, text FROM stored_record WHERE metadata['element_type'] = 'list_item') ORDER BY id LIMIT 20",
        "collection_search": """
            WITH q AS (SELECT embedding AS e FROM stored_record WHERE len(embedding) = 64 ORDER BY id LIMIT 1),
            v AS (SELECT id, any_value(embedding) AS e FROM stored_record WHERE metadata['element_type'] = 'paragraph' AND len(embedding) = 64 GROUP BY id),
            near AS (SELECT id, list_sum(list_transform(list_zip(v.e, q.e), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM v, q)
            SELECT id, round(d, 4) AS distance FROM near WHERE d IS NOT NULL AND NOT isnan(d) ORDER BY d, id LIMIT 10
        """,
        "path_fields": r"""
            WITH f AS (SELECT DISTINCT file_path, string_split(file_path, '/') AS parts FROM snapshot_meta),
            g AS (SELECT *, string_split(regexp_replace(parts[-1], '\.[^.]*$', ''), '_')[1] AS head, list_filter(parts, lambda x: regexp_full_match(x, '[0-9]{14}'))[1] AS stamp,
                list_filter(parts, lambda x: regexp_full_match(x, '[0-9]{4}') AND TRY_CAST(x AS INT) BETWEEN 1990 AND 2030)[1] AS year_part,
                substr(list_filter(parts, lambda x: coalesce(TRY_CAST(substr(x, 1, 4) AS INT) BETWEEN 1990 AND 2030, false))[1], 1, 4) AS year_head FROM f),
            h AS (SELECT *, CASE WHEN regexp_full_match(head, '[0-9]{14}') THEN head END AS led FROM g),
            y AS (SELECT *, coalesce(substr(led, 1, 4), substr(stamp, 1, 4), year_part, year_head, '2020') AS y FROM h)
            SELECT file_path, coalesce(led, stamp, y || '0101000000') AS timestamp, y::INT AS year FROM y
        """,
        "url_formats": r"""
            WITH urls AS (SELECT original_url AS given FROM snapshot_meta UNION SELECT source FROM documents),
            t AS (SELECT given, regexp_matches(given, '^(document|file)://') OR regexp_matches(given, '^(https?|ftp)://[^\s/]+\.[^\s/]+') AS good, regexp_matches(given, '^[a-zA-Z0-9._/-]+$') AS name FROM urls)
            SELECT given, CASE WHEN good THEN given WHEN name THEN 'document://' || given END AS url, CASE WHEN NOT coalesce(good OR name, false) THEN 'Invalid URL format' END AS error FROM t
        """,
        "orphan_names": """
            WITH h AS (SELECT DISTINCT url FROM html_document WHERE url IS NOT NULL), m AS (SELECT DISTINCT url FROM text_block WHERE url IS NOT NULL),
            o AS (SELECT url, 'html' AS kind FROM h WHERE url NOT IN (SELECT url FROM m) UNION ALL SELECT url, 'meta' FROM m WHERE url NOT IN (SELECT url FROM h))
            SELECT string_split(url, '/')[-1] AS name, kind, count(*) AS n FROM o GROUP BY 1, 2
        """,
        "validation_summary": f"""
            WITH d AS (SELECT text AS html, url FROM documents), c AS (SELECT html IS NOT NULL AND {_HTML_OK} AND coalesce(url, '') <> '' AS ok FROM d)
            SELECT count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok) / count(*) AS success_rate FROM c
        """,
        "validation_failures": rf"""
            WITH d AS (SELECT text AS html, url FROM documents), e AS (
                SELECT CASE WHEN html IS NULL OR regexp_matches(html, '^{_BLANK}*$') THEN 'HTML content is empty' WHEN NOT {_HTML_OK} THEN 'no HTML tags found' WHEN coalesce(url, '') = '' THEN 'URL is empty' END AS error, url FROM d)
            SELECT error, count(*) AS n, count(DISTINCT url) AS urls FROM e WHERE error IS NOT NULL GROUP BY error
        """,
        "tree_titles": r"""
            WITH t AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS t, html FROM html_document)
            SELECT page_id, CASE WHEN html IS NULL THEN NULL WHEN t = '' THEN 'Unknown Title'
                ELSE replace(replace(replace(replace(replace(replace(replace(t, '&laquo;', '«'), '&raquo;', '»'), '&ndash;', '–'), '&lt;', '<'), '&gt;', '>'), '&#123;', '{'), '&#125;', '}') END AS title FROM t
        """,
        "event_slides": """
            SELECT w::TIMESTAMP AS window_start, event_type, count(*) AS count
            FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events WHERE ts IS NOT NULL) GROUP BY 1, 2
        """,
        "chunks": rf"""
            WITH d AS (SELECT doc_id, text, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda s: s <> ''), lambda s: [s || '.']) AS pieces
                FROM documents WHERE text IS NOT NULL),
            f AS (SELECT doc_id, text, list_reduce(pieces, lambda a, p: CASE
                WHEN length(a[-1]) + length(p[1]) + 1 <= 512 THEN list_concat(a[:len(a) - 1], [a[-1] || p[1] || ' '])
                WHEN length(p[1]) > 512 THEN list_reduce(
                    list_transform(list_filter(regexp_split_to_array(p[1], '{_BLANK}+'), lambda w: w <> ''), lambda w: [w]),
                    lambda b, w: CASE WHEN length(b[-1]) + length(w[1]) + 1 <= 512 THEN list_concat(b[:len(b) - 1], [b[-1] || w[1] || ' '])
                        ELSE list_concat(b[:len(b) - 1], CASE WHEN trim(b[-1]) <> '' THEN [trim(b[-1])] ELSE [] END, [w[1] || ' ']) END,
                    list_concat(a[:len(a) - 1], CASE WHEN trim(a[-1]) <> '' THEN [trim(a[-1])] ELSE [] END, ['']))
                ELSE list_concat(a[:len(a) - 1], CASE WHEN trim(a[-1]) <> '' THEN [trim(a[-1])] ELSE [] END, [p[1] || ' ']) END, ['']) AS held
                FROM d WHERE length(text) > 512),
            g AS (SELECT doc_id, list_concat(held[:len(held) - 1], CASE WHEN trim(held[-1]) <> '' THEN [trim(held[-1])] ELSE [] END) AS out FROM f)
            SELECT text, doc_id, NULL::INT AS chunk_index, NULL::INT AS total_chunks FROM d WHERE length(text) <= 512
            UNION ALL SELECT unnest(out), doc_id, (generate_subscripts(out, 1) - 1)::INT, len(out)::INT FROM g
        """,
    }
