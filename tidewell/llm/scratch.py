"""Intermediate tables in the folder that driver and executors share.

A table written here cuts the lineage: a lost executor costs a re-read of
Parquet, never a recomputation of what came before, and the driver keeps no
plan of earlier rounds.  The folder is ``spark.checkpoint.dir``; only a local
session (tests, a laptop) may leave it unset, and then has a temporary one.
An operator's tables are deleted when the application ends, or by ``clear``
once its result has been stored.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def _own_folder(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidewell-"))
    return f"file://{_own[0]}"


class Scratch:
    """Named tables of one operator call."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
        self.root = f"{base.rstrip('/')}/tidewell-{uuid.uuid4().hex}"
        folder, files = self._files("")
        files.deleteOnExit(folder)

    def _files(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return it as read back."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        path, files = self._files(name)
        files.delete(path, True)

    def clear(self) -> None:
        """Delete all tables, when what was made of them is stored elsewhere."""
        self.drop("")
