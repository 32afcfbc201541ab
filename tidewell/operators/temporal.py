"""Joins in time: the value in force at a moment, and periods that overlap.

Both cut time into buckets and join within a key and bucket, so that a key with
very many rows is spread over as many tasks as it has buckets, and no row meets
all rows of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000  # microseconds


def micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def _bucket(at: str | Column, width: int) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / F.lit(width)).cast("bigint")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], ties: list[str] | None = None,
          width: int = 30 * DAY) -> DataFrame:
    """Each left row with `values` of its key's last right row at or before it; null where there is none.

    Rows of both sides stand in one table, ordered within a key and bucket of
    `width` microseconds, and each left row takes the last right row before it.
    Where its bucket has none, it takes the last of the buckets before, which is
    carried along one row a key and bucket.  Right rows of one time go by
    `ties`, then by the values; a right row of the left row's own time counts.

    Defined results: a left row without key or time finds nothing and stays; a
    right row without either is no observation; values may be null and are in
    force as such.  The left columns keep their names, `values` are added.
    """
    held = F.struct(micros(right_time).alias("_at"), *[F.col(c) for c in ties or []], *[F.col(c).alias(f"_{c}") for c in values])
    rows = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key).alias("_key"), micros(right_time).alias("_at"), held.alias("_held"))
    asked = left.select(F.struct(*left.columns).alias("_row"), F.col(key).alias("_key"), micros(left_time).alias("_at"))
    known = asked.where(F.col("_key").isNotNull() & F.col("_at").isNotNull())

    both = rows.unionByName(known, allowMissingColumns=True).withColumn("_bucket", _bucket("_at", width))
    tails = both.groupBy("_key", "_bucket").agg(F.max("_held").alias("_tail"))
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumn("_tail", F.last("_tail", ignorenulls=True).over(earlier))

    # of one moment right rows come first, and among these the largest last
    upto = Window.partitionBy("_key", "_bucket").orderBy("_at", F.col("_row").isNotNull(), F.asc_nulls_last("_held")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_held", ignorenulls=True).over(upto)).where(F.col("_row").isNotNull())
    found = found.join(tails, ["_key", "_bucket"], "left").select("_row", F.coalesce("_last", "_tail").alias("_last"))
    rest = asked.where(F.col("_key").isNull() | F.col("_at").isNull()).select("_row", F.lit(None).alias("_last"))
    return found.unionByName(rest).select("_row.*", *[F.col("_last")[f"_{c}"].alias(c) for c in values])


def valid_periods(changes: DataFrame, key: str, time: str, values: list[str], ties: list[str] | None = None) -> DataFrame:
    """(key, *values, begins, ends): each row of a history is in force until the next of its key; the last has no end."""
    following = F.lead(time).over(Window.partitionBy(key).orderBy(time, *(ties or [])))
    return changes.select(key, *values, F.col(time).alias("begins"), following.alias("ends"))


def overlapping(left: DataFrame, right: DataFrame, key: str | None = None, width: int = DAY) -> DataFrame:
    """Pairs of rows (of one key) whose periods [begins, ends) overlap.

    A period stands in every bucket of `width` microseconds that it touches, and
    a pair is taken in the later one of their first buckets alone, so no pair
    comes twice and none is compared outside a bucket.  Periods without an end
    last to the end of the other side's times, so that they touch a finite number.

    The left columns keep their names, the right ones too unless the left has
    them, then they are called right_<name>.  Defined results: an empty or
    backward period overlaps nothing; a period without a beginning is none.
    """
    horizon = left.select(*_ends()).unionAll(right.select(*_ends())).agg(F.max("b"), F.max("e")).first()
    horizon = max(x for x in (*horizon, 0) if x is not None) + 1

    def dealt(df: DataFrame, side: str) -> DataFrame:
        begins, ends = micros("begins"), F.coalesce(micros("ends"), F.lit(horizon))
        df = df.select(F.struct(*df.columns).alias(side), *([F.col(key).alias("_key")] if key else [F.lit(0).alias("_key")]), begins.alias(f"{side}_from"), ends.alias(f"{side}_to"))
        df = df.where(F.col(f"{side}_from") < F.col(f"{side}_to")).withColumn(f"{side}_first", _bucket(f"{side}_from", width))
        return df.withColumn("_bucket", F.explode(F.sequence(F.col(f"{side}_first"), _bucket(F.col(f"{side}_to") - 1, width))))

    pairs = dealt(left, "_l").join(dealt(right, "_r"), ["_key", "_bucket"])
    pairs = pairs.where("_bucket = greatest(_l_first, _r_first) AND _l_from < _r_to AND _r_from < _l_to")
    named = [F.col("_r")[c].alias(c if c not in left.columns else f"right_{c}") for c in right.columns if c != key]
    return pairs.select("_l.*", *named)


def _ends() -> list[Column]:
    return [micros("begins").alias("b"), micros("ends").alias("e")]
