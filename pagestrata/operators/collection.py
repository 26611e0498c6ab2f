"""Collections of embedded blocks: versioned Parquet directories with append, update, search and statistics.

A collection is a directory, on any filesystem Spark reaches, with data versions ``v1``, ``v2``... and a pointer
file. Within a version every append and every update is a numbered part of its own, so its cost is that of the
rows it brings and not of the collection; a row is hidden where a later update brings its id. Compaction
writes the rows that show as the next version when the parts have become many and large; :meth:`Collection.vacuum`
drops versions nobody needs. A plan never overwrites what it reads. Ids are a digest of url, position, chunk and text.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.errors import CollectionError
from pagestrata.functions.validate import collection_name
from pagestrata.functions.vectors import cosine, literal, squared_distance
from pagestrata.operators.where import compile_where
from pagestrata.schemas import CAPTURE_COLUMNS, STORED
from pagestrata.storage import Store


def metadata_map(blocks: DataFrame) -> Column:
    """All scalar columns but text and vector as strings: url, kind, level and position always (null as empty), others where they are given."""
    always = ("url", "element_type", "hierarchy_level", "position")
    has_capture = F.coalesce(*[F.col(c) for c in CAPTURE_COLUMNS]).isNotNull()
    entries = [F.struct(F.lit(c).alias("k"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v"), F.lit(True).alias("use")) for c in always]
    entries += [F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"), F.col(c).isNotNull().alias("use")) for c in ("chunk_index", "total_chunks")]
    entries += [F.struct(F.lit(c).alias("k"), F.coalesce(F.col(c), F.lit("")).alias("v"), has_capture.alias("use")) for c in CAPTURE_COLUMNS]
    used = F.filter(F.array(*entries), lambda e: e["use"])
    return F.map_from_entries(F.transform(used, lambda e: F.struct(e["k"], e["v"])))


def stored_rows(blocks: DataFrame) -> DataFrame:
    """Embedded blocks in the form of a collection."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.sha2(F.concat_ws("\u0001", part("url"), part("position"), part("chunk_index"), part("text")), 256)
    cols = [f.name for f in STORED.fields if f.name not in ("id", "metadata")]
    return blocks.withColumn("id", key).withColumn("metadata", metadata_map(blocks)).select(*[f.name for f in STORED.fields if f.name in ("id", "metadata") or f.name in cols])


def nearest(rows: DataFrame, query: Sequence[float], k: int = 10, where: Mapping | None = None, vec_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """The k rows nearest to a vector: filter, squared distance, score = 1 - distance; ties by id.

    One scan and a top-k per task; neither join nor shuffle. Vectors of another size are left out.
    """
    condition = compile_where(where)
    found = rows if condition is None else rows.filter(condition)
    q = literal(query)
    scored = found.withColumn("distance", squared_distance(F.col(vec_col), q)).filter(F.col("distance").isNotNull() & ~F.isnan("distance"))
    return scored.withColumn("similarity_score", 1 - F.col("distance")).orderBy("distance", id_col).limit(k)


def above(hits: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Hits at a threshold or more, applied after the top-k; none where the threshold is not positive."""
    return hits.filter(F.col("similarity_score") >= threshold) if threshold > 0 else hits


def with_cosine(rows: DataFrame, query: Sequence[float], vec_col: str = "embedding") -> DataFrame:
    """Rows with their cosine to a vector."""
    return rows.withColumn("cosine", cosine(F.col(vec_col), literal(query)))


class Collection:
    """A named collection below a directory."""

    MANY, TOO_MANY = 16, 256  # parts beyond which a version is compacted: if they are large, or in any case

    def __init__(self, spark: SparkSession, name: str = "html_documents", directory: str = "./collections"):
        self.spark, self.name, self.directory = spark, collection_name(name), directory
        self.store = Store(spark)
        self.path = f"{directory.rstrip('/')}/{name}"
        self._pointer = f"{self.path}/current.json"
        if not self.store.exists(self._pointer):
            self._write_empty(1)

    def _state(self) -> dict:
        return json.loads(self.store.read(self._pointer))

    def _data(self, version: int | None = None) -> str:
        return f"{self.path}/v{version or self._state()['version']}"

    def _point(self, version: int, parts: int, updates: list[int]) -> None:
        self.store.write(self._pointer, json.dumps({"version": version, "parts": parts, "updates": updates}))

    def _write_empty(self, version: int) -> None:
        self.store.make_dirs(self._data(version))
        self._point(version, 0, [])

    def rows(self) -> DataFrame:
        """All rows that show."""
        state = self._state()
        paths = [f"{self._data(state['version'])}/part-{i}" for i in range(state["parts"])]
        if not paths:
            return self.spark.createDataFrame([], STORED)
        if not state["updates"]:
            return self.spark.read.schema(STORED).parquet(*paths)
        rows = self.spark.read.schema(STORED).parquet(*paths).withColumn("_part", F.regexp_extract(F.col("_metadata.file_path"), r"/part-(\d+)/[^/]*$", 1).cast("int"))
        last = rows.filter(F.col("_part").isin(state["updates"])).groupBy("id").agg(F.max("_part").alias("_last"))
        shown = rows.join(last, "id", "left").filter(F.col("_last").isNull() | (F.col("_part") >= F.col("_last")))
        return shown.select(*STORED.names)

    def _add_part(self, rows: DataFrame, update: bool) -> None:
        state = self._state()
        rows.select(*STORED.names).write.mode("overwrite").parquet(f"{self._data(state['version'])}/part-{state['parts']}")
        self._point(state["version"], state["parts"] + 1, state["updates"] + [state["parts"]] * update)
        self._maybe_compact()

    def add(self, blocks: DataFrame) -> None:
        """Append embedded blocks; nothing is deduplicated."""
        self._add_part(stored_rows(blocks), False)

    def search(self, query: Sequence[float], k: int = 10, where: Mapping | None = None, threshold: float = 0.0) -> DataFrame:
        """(text, metadata, distance, similarity_score, id) of the nearest rows."""
        return above(nearest(self.rows(), query, k, where), threshold).select("text", "metadata", "distance", "similarity_score", "id")

    def search_by_text(self, text: str, embedder, k: int = 10, where: Mapping | None = None, threshold: float = 0.0) -> DataFrame:
        """The rows nearest to a text, embedded by ``embedder``."""
        return self.search(embedder.encode([text])[0].tolist(), k, where, threshold)

    def get(self, where: Mapping | None = None, limit: int | None = None) -> DataFrame:
        """(text, metadata) of all rows that match, by id."""
        condition = compile_where(where)
        found = self.rows() if condition is None else self.rows().filter(condition)
        found = found.orderBy("id") if limit else found
        return (found.limit(limit) if limit else found).select("text", "metadata")

    def stats(self) -> dict:
        """Name, number of rows and directory."""
        return {"collection_name": self.name, "document_count": self.rows().count(), "persist_directory": self.directory}

    def update(self, changes: DataFrame) -> None:
        """Replace the rows whose id is in ``changes`` (rows of the stored form); new ids are added."""
        self._add_part(changes, True)

    def upsert(self, blocks: DataFrame) -> None:
        """Add embedded blocks, replacing those with equal ids."""
        self.update(stored_rows(blocks).dropDuplicates(["id"]))

    def _maybe_compact(self) -> None:
        state = self._state()
        if state["parts"] <= self.MANY:
            return
        sizes = [self.store.size(f"{self._data(state['version'])}/part-{i}") for i in range(state["parts"])]
        if state["parts"] > self.TOO_MANY or sum(sizes[1:]) > sizes[0]:
            self.compact()

    def compact(self) -> None:
        """Write the rows that show as one part of the next version."""
        state = self._state()
        self.rows().write.mode("overwrite").parquet(f"{self._data(state['version'] + 1)}/part-0")
        self._point(state["version"] + 1, 1, [])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drop all but the ``keep`` newest versions up to the current one; only when no running plan reads them."""
        now = self._state()["version"]
        old = [x for x in self.store.names(self.path) if x.startswith("v") and x[1:].isdigit() and int(x[1:]) <= now - keep]
        for x in old:
            self.store.delete(f"{self.path}/{x}")
        return old

    def reset(self) -> None:
        """An empty collection; older versions stay until :meth:`vacuum`."""
        self._write_empty(self._state()["version"] + 1)

    def drop(self) -> None:
        """Remove the collection with all versions."""
        if not self.store.exists(self._pointer):
            raise CollectionError("no such collection", name=self.name)
        self.store.delete(self.path)
