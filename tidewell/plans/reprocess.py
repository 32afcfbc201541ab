"""SRC-27: stored raw listings run again under other rules, without another crawl.

A run carries the version of its rules as a column, reads only the folders of
the malls and days it is asked for, and may be held against another version row
by row: what became valid, what failed anew, and whose identity moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes
from . import listing

Rules = Callable[[DataFrame], DataFrame]
KEY = ("mall", "crawl_date", "seq")


def read_raw(spark: SparkSession, path: str, malls: Iterable[str] | None = None, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Raw folders as `sources.files.write_raw` makes them; malls and days prune folders before anything is read."""
    rows = spark.read.schema(f"{listing.RAW}, crawl_date date").json(path)
    if malls is not None:
        rows = rows.where(F.col("mall").isin(list(malls)))
    if first_day is not None:
        rows = rows.where(F.col("crawl_date") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        rows = rows.where(F.col("crawl_date") <= F.lit(last_day).cast("date"))
    return rows


def run(raw: DataFrame, version: str, rules: Rules = listing.process) -> DataFrame:
    """The processed rows, each with the version of the rules; the raw mall is kept beside the processed one."""
    return rules(raw.withColumn("raw_mall", F.col("mall"))).withColumn("rules_version", F.lit(version))


def outcomes(processed: DataFrame) -> DataFrame:
    """(mall, crawl_date, seq, status, field, canonical_product_id, price, seller_id, rules_version): what the rules made of each raw row."""
    error = F.col("error")
    return processed.select(
        F.col("raw_mall").alias("mall"), "crawl_date", "seq", F.coalesce(error["status"], F.lit("VALID")).alias("status"), error["field"].alias("field"),
        "canonical_product_id", "price", "seller_id", "rules_version",
    )


def write(processed: DataFrame, path: str) -> None:
    """Outcomes by version and day; a run that is repeated writes its own partitions anew."""
    outcomes(processed).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rules_version", "crawl_date").parquet(path)


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """The raw rows whose outcome is not the same: (mall, crawl_date, seq, change, changed, old, new)."""
    return changes.changes(before.drop("rules_version"), after.drop("rules_version"), list(KEY))


def moved(difference: DataFrame) -> DataFrame:
    """How many rows went from one status to another, and how many kept it with another identity, price or field."""
    kind = F.concat_ws(" -> ", F.coalesce(F.col("old")["status"], F.lit("none")), F.coalesce(F.col("new")["status"], F.lit("none")))
    return difference.groupBy(kind.alias("move")).agg(F.count(F.lit(1)).alias("rows"))
