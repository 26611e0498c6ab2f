"""Small files and directories on any filesystem Spark can reach (local, HDFS, object stores), by its own filesystem layer."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """File operations below a Spark session; paths are as Spark takes them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm = spark.sparkContext._jvm

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        """The text of a small file."""
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write a small file in one piece: beside it first, then renamed over it."""
        fs, p = self._at(path)
        beside = self._jvm.org.apache.hadoop.fs.Path(path + ".new")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(beside, p):
            raise OSError(f"cannot write {path}")

    def make_dirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def size(self, path: str) -> int:
        """Bytes below a path, 0 where there is none."""
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def names(self, path: str) -> list[str]:
        """Names in a directory, sorted."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
