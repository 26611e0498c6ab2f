"""Session helpers: tables by path, and tables written to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from pagestrata.storage import Store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a fresh local one in local mode only.

    On a cluster every executor would write to its own disk, so there the setting is needed.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="pagestrata-checkpoint-")
        spark.sparkContext.setCheckpointDir(got)
    return got


_WRITTEN: dict[str, list[str]] = {}


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_stored(spark: SparkSession) -> int:
    """Delete all tables that :func:`stored` wrote in this application; results that read them must have been used."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    store = Store(spark)
    for path in paths:
        store.delete(path)
    return len(paths)
