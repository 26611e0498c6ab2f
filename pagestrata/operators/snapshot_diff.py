"""What changed between consecutive full snapshots (problem 6).

Method: every key (page of a job) is windowed by snapshot index. A lag to the index before compares the
hash of its values; a gap in the index reveals a removal after, and an addition at, the ends of the gap.

Scale. The index of a snapshot in its job comes from a two-level count - snapshots within a day, days
within a job - so no window holds more than a day's or a job's days. A key's history is cut into blocks
of ``block`` snapshots; a row at a block's edge is lent to the block next to it, because it takes part
in the comparison across the edge. So a key with any number of snapshots is spread over many tasks, and
still every comparison is made exactly once.

Cases: rows with a null url, or a timestamp that is not 14 digits with month 01-12, count for nothing;
of several rows of a page in one snapshot the one with the greatest ``processed_at`` counts (null is
least; ties go to the greater id); null values equal null; a null job is a job of its own; repeated
deliveries change nothing; an empty table gives no rows; a job's first snapshot gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagestrata.functions.urls import url_key

TIMESTAMP = r"^[0-9]{4}(?:0[1-9]|1[0-2])[0-9]{8}$"


def value_hash(columns: list[str]) -> Column:
    """A 64-bit hash of several values in which null differs from every value and from its place."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def latest_rows(rows: DataFrame, values: list[str]) -> DataFrame:
    """(job, ts, key, h): one row per page and snapshot, by greatest ``processed_at``."""
    fine = rows.filter(F.col("original_url").isNotNull() & F.col("timestamp").rlike(TIMESTAMP))
    slim = fine.select(F.col("crawl_job").alias("job"), F.col("timestamp").alias("ts"), url_key(F.col("original_url")).alias("key"), F.struct(F.coalesce("processed_at", F.lit(float("-inf"))).alias("p"), F.coalesce("meta_id", F.lit(-1)).alias("m"), value_hash(values).alias("h")).alias("v"))
    return slim.groupBy("job", "ts", "key").agg(F.max("v").alias("v")).select("job", "ts", "key", F.col("v.h").alias("h"))


def snapshot_index(rows: DataFrame) -> DataFrame:
    """(job, ts, idx, next_ts): snapshots of each job numbered from 1 in time, with the one after."""
    snaps = rows.select("job", "ts").distinct().withColumn("day", F.substring("ts", 1, 8))
    in_day = Window.partitionBy("job", "day").orderBy("ts")
    days = snaps.groupBy("job", "day").agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    by_day = Window.partitionBy("job").orderBy("day")
    days = days.select("job", "day", (F.sum("n").over(by_day) - F.col("n")).alias("before"), F.lead("first").over(by_day).alias("after"))
    numbered = snaps.withColumns({"k": F.row_number().over(in_day), "soon": F.lead("ts").over(in_day)})
    return numbered.alias("s").join(days.alias("d"), F.expr("s.job <=> d.job AND s.day = d.day")).select("s.job", "s.ts", (F.col("before") + F.col("k")).alias("idx"), F.coalesce("soon", "after").alias("next_ts"))


def snapshot_changes(rows: DataFrame, values: list[str], block: int = 1024) -> DataFrame:
    """(job, ts, key, change): what was added, removed or changed from one snapshot of a job to the next."""
    latest = latest_rows(rows, values)
    index = snapshot_index(latest)
    placed = latest.alias("r").join(index.alias("i"), F.expr("r.job <=> i.job AND r.ts = i.ts")).select("r.job", "r.ts", "key", "h", "idx", "next_ts")
    home = F.floor((F.col("idx") - 1) / block)
    lent = F.when(F.col("idx") % block == 0, home + 1).when((F.col("idx") % block == 1) & (F.col("idx") > 1), home - 1)
    spread = placed.withColumn("home", home).withColumn("block", F.explode(F.filter(F.array(home, lent), lambda x: x.isNotNull())))
    line = Window.partitionBy("job", "key", "block").orderBy("idx")
    seen = spread.select("*", F.lag("idx").over(line).alias("i0"), F.lag("h").over(line).alias("h0"), F.lead("idx").over(line).alias("i1")).filter("block = home")
    follows = F.coalesce(F.col("i0") == F.col("idx") - 1, F.lit(False))
    arrives = F.when(~follows & (F.col("idx") > 1), F.lit("added")).when(follows & (F.col("h0") != F.col("h")), F.lit("changed"))
    leaves = F.when(F.col("next_ts").isNotNull() & ~F.coalesce(F.col("i1") == F.col("idx") + 1, F.lit(False)), F.lit("removed"))
    events = F.filter(F.array(F.struct(F.col("ts"), arrives.alias("change")), F.struct(F.col("next_ts").alias("ts"), leaves.alias("change"))), lambda e: e["change"].isNotNull())
    return seen.select("job", "key", F.explode(events).alias("e")).select("job", "e.ts", "key", "e.change")


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Pages added, removed or changed between consecutive snapshots of every crawl job."""
    from pagestrata.session import table

    got = snapshot_changes(table(spark, sf_dir, "snapshot_meta"), ["content_length", "links_found", "images_found"])
    return got.select(F.col("job").alias("crawl_job"), F.col("ts").alias("timestamp"), F.col("key").alias("url_key"), "change")


P6_SQL = r"""
    WITH fine AS (
        SELECT crawl_job, timestamp, meta_id, coalesce(processed_at, '-inf'::DOUBLE) AS p, content_length, links_found, images_found,
            regexp_replace(
                regexp_replace(regexp_replace(lower(regexp_extract(original_url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)([^#]*)', 1)), '^www\.', ''), ':[0-9]*$', '')
                || regexp_extract(original_url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)([^#]*)', 2), '/+$', '') AS url_key
        FROM snapshot_meta WHERE original_url IS NOT NULL AND regexp_matches(timestamp, '^[0-9]{4}(?:0[1-9]|1[0-2])[0-9]{8}$')
    ), latest AS (
        SELECT * FROM fine QUALIFY row_number() OVER (PARTITION BY crawl_job, timestamp, url_key ORDER BY p DESC, meta_id DESC) = 1
    ), snaps AS (
        SELECT crawl_job, timestamp, row_number() OVER (PARTITION BY crawl_job ORDER BY timestamp) AS idx FROM (SELECT DISTINCT crawl_job, timestamp FROM latest)
    ), placed AS (
        SELECT l.*, s.idx FROM latest l JOIN snaps s ON l.crawl_job IS NOT DISTINCT FROM s.crawl_job AND l.timestamp = s.timestamp
    )
    SELECT a.crawl_job, a.timestamp, a.url_key, CASE WHEN b.url_key IS NULL THEN 'added' ELSE 'changed' END AS change
    FROM placed a LEFT JOIN placed b ON a.crawl_job IS NOT DISTINCT FROM b.crawl_job AND a.url_key = b.url_key AND a.idx = b.idx + 1
    WHERE a.idx > 1 AND (b.url_key IS NULL OR a.content_length IS DISTINCT FROM b.content_length OR a.links_found IS DISTINCT FROM b.links_found OR a.images_found IS DISTINCT FROM b.images_found)
    UNION ALL
    SELECT s.crawl_job, s.timestamp, b.url_key, 'removed' AS change
    FROM placed b JOIN snaps s ON b.crawl_job IS NOT DISTINCT FROM s.crawl_job AND s.idx = b.idx + 1
    LEFT JOIN placed a ON a.crawl_job IS NOT DISTINCT FROM b.crawl_job AND a.url_key = b.url_key AND a.idx = b.idx + 1
    WHERE a.url_key IS NULL
"""
