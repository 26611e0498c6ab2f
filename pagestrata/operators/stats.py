"""Aggregates over results and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def processing_stats(rows: DataFrame, ok: Column) -> DataFrame:
    """processed, errors, total and success rate in percent (0 where there is nothing)."""
    good = F.coalesce(ok, F.lit(False))
    sums = rows.agg(F.count_if(good).alias("processed"), F.count_if(~good).alias("errors"), F.count("*").alias("total"))
    return sums.withColumn("success_rate", _ratio(F.col("processed") * 100.0, F.col("total")))


def batch_summary(results: DataFrame) -> DataFrame:
    """total, successful, failed and success rate as a fraction."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return results.agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed")).withColumn("success_rate", _ratio(F.col("successful").cast("double"), F.col("total")))


def corpus_stats(results: DataFrame) -> DataFrame:
    """Sums and averages of results with compression and extraction ratios."""
    sums = results.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("original_html_length"), F.lit(0)).alias("html_chars"), F.coalesce(F.sum("cleaned_html_length"), F.lit(0)).alias("cleaned_chars"), F.coalesce(F.sum("text_blocks_count"), F.lit(0)).alias("blocks"),
        F.coalesce(F.sum("chunked_blocks_count"), F.lit(0)).alias("chunks"), F.coalesce(F.avg("text_blocks_count"), F.lit(0.0)).alias("blocks_per_document"),
    )
    return sums.withColumns({"compression_ratio": _ratio(F.col("cleaned_chars").cast("double"), F.col("html_chars")), "extraction_ratio": _ratio(F.col("blocks") * 100.0, F.col("cleaned_chars"))})


def throughput(results: DataFrame, seconds: float) -> DataFrame:
    """Documents, documents a second, seconds a document and megabytes of html of a run that took ``seconds``."""
    sums = results.agg(F.count("*").alias("documents"), (F.coalesce(F.sum("original_html_length"), F.lit(0)) / 1e6).alias("html_mb"))
    took = F.lit(float(seconds))
    return sums.withColumns({"documents_per_second": _ratio(F.col("documents").cast("double"), took), "seconds_per_document": _ratio(took, F.col("documents").cast("double"))})


def failures(results: DataFrame) -> DataFrame:
    """Urls and errors of failed documents."""
    return results.filter(~F.coalesce(F.col("success"), F.lit(False))).select("url", "error")


def histogram(rows: DataFrame, value: Column, name: str, default: str = "unknown") -> DataFrame:
    """Counts by value, null as ``default``."""
    return rows.groupBy(F.coalesce(value, F.lit(default)).alias(name)).agg(F.count("*").alias("count"))


def domain_histogram(rows: DataFrame) -> DataFrame:
    """Rows by capture domain."""
    return histogram(rows, F.col("metadata")["wayback_domain"], "domain")


def year_histogram(rows: DataFrame) -> DataFrame:
    """Rows by the year of their capture timestamp."""
    return histogram(rows, F.substring(F.col("metadata")["wayback_timestamp"], 1, 4), "year")


def top(counts: DataFrame, name: str, k: int = 10) -> DataFrame:
    """The k greatest counts; ties by name."""
    return counts.orderBy(F.desc("count"), name).limit(k)


def distinct_counts(rows: DataFrame) -> DataFrame:
    """Number of different domains and years."""
    year = F.substring(F.col("metadata")["wayback_timestamp"], 1, 4)
    return rows.agg(F.countDistinct(F.coalesce(F.col("metadata")["wayback_domain"], F.lit("unknown"))).alias("domains"), F.countDistinct(year).alias("years"))
