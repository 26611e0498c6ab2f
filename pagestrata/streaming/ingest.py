"""Structured Streaming: documents that arrive as files, ingested into a collection; windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagestrata.operators.collection import Collection
from pagestrata.operators.embed import Embedder, HashedNgrams
from pagestrata.plans.pipeline import block_rows, embedded_blocks, parsed_pages
from pagestrata.config import PipelineConfig
from pagestrata.functions.chunks import chunked
from pagestrata.schemas import DOCUMENT
from pyspark.sql import types as T


def document_stream(spark: SparkSession, directory: str, files_per_trigger: int = 100) -> DataFrame:
    """Documents from JSON-lines files that appear in a directory; ``ingested_at`` is the event time."""
    schema = T.StructType([*DOCUMENT.fields, T.StructField("ingested_at", T.TimestampType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(directory)


def once_each(docs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Documents without repeats of url and html within the watermark."""
    keyed = docs.withColumn("content_hash", F.sha2(F.concat_ws("\u0001", "url", "html"), 256)).withWatermark("ingested_at", late)
    return keyed.dropDuplicatesWithinWatermark(["content_hash"]).drop("content_hash")


def ingest_stream(docs: DataFrame, collection: Collection, checkpoint: str, config: PipelineConfig | None = None, embedder: Embedder | None = None, available_now: bool = True) -> StreamingQuery:
    """Ingest a document stream into a collection, batch by batch; ids are digests, so a replayed batch replaces itself."""
    config, embedder = config or PipelineConfig(), embedder or HashedNgrams()

    def write(batch: DataFrame, _: int) -> None:
        pages = parsed_pages(batch, config)
        collection.upsert(embedded_blocks(chunked(block_rows(pages), config.max_chunk_size), embedder))

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time_col: str, keys: list[str], width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts of a (streaming or static) table by time window and keys, with a watermark for late rows."""
    window = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return events.withWatermark(time_col, late).groupBy(window.alias("window"), *keys).agg(F.count("*").alias("count")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "count")
