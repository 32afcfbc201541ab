"""Catalog tables as plain Parquet tables whose partitions tell the batch.

Tables of events (history, logs, jobs) are partitioned by `batch`.  Tables of
state (products, listings, ...) are partitioned by `part`, a hash of the key, and
by `batch`: a batch writes the parts that its keys touch, whole, and leaves the
files of all others alone; of each part the newest version is in force.

A batch is complete once its row is in `crawl_jobs`, which is written last;
readers see the partitions of complete batches alone, so all of a batch or none.
Writes replace a batch's own partitions, which nothing reads before: a batch
that failed anywhere runs again and gives the same tables.  One writer at a
time.  Of a part's versions the newest KEEP complete ones stay for readers that
began before, older ones go when a batch completes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64  # of a table of state; many enough that a part suits one task, the same for the life of a store
KEEP = 2
JOBS = "crawl_jobs"


class Store:
    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self, pattern: str) -> list[tuple[int, object]]:
        """(batch, folder) of every partition that fits."""
        path, files = self._path(pattern)
        return [(int(f.getPath().getName().removeprefix("batch=")), f.getPath()) for f in files.globStatus(path) or []]

    def _there(self, name: str) -> bool:
        path, files = self._path(name)
        return files.exists(path)

    def part(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.parts)).cast("int")

    # ---- reading
    def committed(self, batch: int) -> bool:
        """Whether a batch is complete."""
        return self._there(f"{JOBS}/batch={batch}")  # it comes into being by one rename

    def last(self, before: int | None = None) -> int:
        """The newest complete batch (before one); 0 if there is none."""
        return max((n for n, _ in self._folders(f"{JOBS}/batch=*") if before is None or n < before), default=0)

    def read(self, name: str, schema: str, before: int | None = None, parts: Iterable[int] | None = None) -> DataFrame:
        """A table of state as of the last complete batch (before one), or some of its parts; empty if none wrote it."""
        last, newest = self.last(before), {}
        for number, folder in self._folders(f"{name}/part=*/batch=*"):  # few versions a part
            part = int(folder.getParent().getName().removeprefix("part="))
            if number <= last and (parts is None or part in set(parts)) and number > newest.get(part, (0, ""))[0]:
                newest[part] = (number, folder.toString())
        if not newest:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*[folder for _, folder in newest.values()])

    def read_all(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """A table of events, all complete batches (before one), each row with its `batch`."""
        if not self._there(name):
            return self.spark.createDataFrame([], f"{schema}, batch bigint")
        rows = self.spark.read.parquet(f"{self.root}/{name}").withColumn("batch", F.col("batch").cast("bigint"))
        return rows.where(F.col("batch") <= self.last(before))

    def _batch(self, name: str, batch: int, schema) -> DataFrame:
        if not self._there(f"{name}/batch={batch}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/batch={batch}")

    # ---- writing
    def append(self, name: str, df: DataFrame, batch: int) -> DataFrame:
        """df as the rows of a batch, read back."""
        self._write(name, df.withColumn("batch", F.lit(batch).cast("bigint")), ["batch"])
        return self._batch(name, batch, df.schema)

    def update(self, name: str, schema: str, key: str, keys: DataFrame, batch: int, change: Callable[[DataFrame], DataFrame]) -> None:
        """The parts that hold `keys` (a table with the key column) as `change` makes them of what was there before the batch."""
        touched = [r.part for r in keys.select(self.part(key).alias("part")).distinct().collect()]  # at most `parts`
        if touched:
            new = change(self.read(name, schema, batch, touched)).withColumns({"part": self.part(key), "batch": F.lit(batch).cast("bigint")})
            self._write(name, new.hint("rebalance", "part"), ["part", "batch"])

    def _write(self, name: str, df: DataFrame, by: list[str]) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.root}/{name}")

    def complete(self, job: DataFrame, batch: int, state: Iterable[str] = ()) -> None:
        """Make a batch visible, and drop what no reader needs of the tables of state."""
        if batch <= self.last():
            raise ValueError(f"batch {batch} is not after batch {self.last()}")
        self.append(JOBS, job, batch)
        for name in state:
            self._retire(name, batch)

    def _retire(self, name: str, batch: int) -> None:
        _, files = self._path(name)
        versions: dict[str, list[tuple[int, object]]] = {}
        for number, folder in self._folders(f"{name}/part=*/batch=*"):
            if number <= batch:
                versions.setdefault(folder.getParent().getName(), []).append((number, folder))
        for mine in versions.values():
            for _, folder in sorted(mine, key=lambda x: x[0])[:-KEEP]:
                files.delete(folder, True)
