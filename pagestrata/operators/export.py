"""Export of a collection as JSON or CSV: sharded by Spark, or as one file."""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.errors import error_of


def flat_columns(rows: DataFrame) -> DataFrame:
    """text and one column per metadata key that occurs: the superset of all rows."""
    keys = sorted(r[0] for r in rows.select(F.explode(F.map_keys("metadata")).alias("k")).distinct().collect())  # as many as there are metadata columns
    return rows.select("text", *[F.col("metadata")[k].alias(k) for k in keys])


def export_sharded(rows: DataFrame, path: str, form: str = "json") -> None:
    """A directory of JSON lines or CSV parts, written by the tasks."""
    if form == "json":
        rows.select("text", "metadata").write.mode("overwrite").json(path)
    elif form == "csv":
        flat_columns(rows).write.mode("overwrite").option("header", "true").csv(path)
    else:
        raise error_of("validate", "unsupported export format", format=form)


def export_file(rows: DataFrame, path: str, form: str = "json") -> int:
    """One JSON array or CSV file on the driver, written row by row as partitions arrive; returns the number of rows."""
    if form not in ("json", "csv"):
        raise error_of("validate", "unsupported export format", format=form)
    out = rows.select("text", "metadata") if form == "json" else flat_columns(rows)
    it = out.toLocalIterator(prefetchPartitions=True)
    n = 0
    if form == "json":
        with open(path, "w", encoding="utf-8") as f:
            f.write("[")
            for n, r in enumerate(it, 1):
                f.write(("," if n > 1 else "") + "\n" + json.dumps(r.asDict(recursive=True), ensure_ascii=False, indent=2))
            f.write("\n]")
        return n
    first = next(it, None)
    if first is None:
        return 0
    with open(path + ".part", "w", encoding="utf-8", newline="") as f:
        writer = csv.writer(f)
        writer.writerow(out.columns)
        writer.writerow(first)
        n = 1
        for r in it:
            writer.writerow(r)
            n += 1
    os.replace(path + ".part", path)
    return n
