"""Change-only price history.

`change_points` takes arrivals in time order: one window with lag.  `replay` is
exact for any order of arrival: a price is compared with that of the latest
stored time, whatever its own time, and a stored row of the same millisecond is
replaced.  Listings without a late arrival, most of them, go by a window as
well.  For the others it is a sequential rule: their rows are sorted by arrival
and folded as they stream by; a listing of any length needs the memory of its
last state alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY = "listing_id string, seq bigint, at_ms bigint, price bigint, previous_price bigint, price_change bigint"


def change_points(prices: DataFrame, key: str, time: str, price: str, seq: str) -> DataFrame:
    """WIN-1, WIN-2: rows whose price is not that of the row before, with previous_price and price_change.

    Rows without a price are no observations; those of one time are in the order of `seq`.
    """
    before = F.lag(price).over(Window.partitionBy(key).orderBy(time, seq))
    found = prices.where(F.col(price).isNotNull()).withColumn("previous_price", before)
    found = found.where(F.col("previous_price").isNull() | (F.col("previous_price") != F.col(price)))
    return found.withColumn("price_change", F.col(price) - F.col("previous_price"))


def in_order(prices: DataFrame, key: str, time: str, seq: str) -> DataFrame:
    """One row: whether no arrival is older than the one before it, so that change_points is exact."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(seq))
    return prices.select((before > F.col(time)).alias("late")).agg((~F.coalesce(F.bool_or("late"), F.lit(False))).alias("in_order"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    listing = latest = current = None
    for batch in batches:
        out: list[tuple] = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("listing_id", "seq", "at_ms", "price", "stored_at", "stored_price")), strict=True)
        for name, seq, at, price, stored_at, stored_price in rows:
            if name != listing:
                listing, latest, current = name, stored_at, stored_price
            if current is not None and price == current:
                continue
            out.append((name, seq, at, price, current, None if current is None else price - current))
            if latest is None or at >= latest:
                latest, current = at, price
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = (pa.string(), *[pa.int64()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["listing_id", "seq", "at_ms", "price", "previous_price", "price_change"])


def latest_stored(history: DataFrame) -> DataFrame:
    """AGG-1: of each listing the time and price of its latest row."""
    known = history.where("price IS NOT NULL AND at_ms IS NOT NULL")
    return known.groupBy("listing_id").agg(F.max("at_ms").alias("stored_at"), F.max_by("price", "at_ms").alias("stored_price"))


def merge_latest(latest: DataFrame, appended: DataFrame) -> DataFrame:
    """latest_stored after a batch, from that before it and what the batch appended: the cost of listings, not of their history."""
    new = latest_stored(appended).toDF("listing_id", "new_at", "new_price")
    both = latest.join(new, "listing_id", "full_outer")
    newer = F.coalesce(F.col("new_at") >= F.col("stored_at"), F.col("stored_at").isNull())
    return both.select("listing_id", *[F.when(newer, F.col(f"new_{c}")).otherwise(F.col(f"stored_{c}")).alias(f"stored_{c}") for c in ("at", "price")])


def newest(history: DataFrame) -> DataFrame:
    """Of appended rows (with `batch`) of one listing and millisecond, that of the latest batch."""
    columns = [c for c in history.columns if c not in ("listing_id", "at_ms", "batch")]
    return history.groupBy("listing_id", "at_ms").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("listing_id", "at_ms", "r.*")


def replay(arrivals: DataFrame, history: DataFrame | None = None, latest: DataFrame | None = None) -> DataFrame:
    """WIN-1 exactly: the rows that arrivals (listing_id, seq, at_ms, price) append to history, or to one whose latest_stored is given."""
    rows = arrivals.where("price IS NOT NULL AND at_ms IS NOT NULL").select("listing_id", "seq", "at_ms", F.col("price").cast("bigint").alias("price"))
    if history is None and latest is None:
        rows = rows.selectExpr("*", "CAST(NULL AS BIGINT) AS stored_at", "CAST(NULL AS BIGINT) AS stored_price")
    else:
        rows = rows.join(latest_stored(history) if latest is None else latest, "listing_id", "left")
    of_listing, arrival = Window.partitionBy("listing_id"), Window.partitionBy("listing_id").orderBy("seq", "at_ms", "price")
    rows = rows.withColumn("before", F.coalesce(F.lag("at_ms").over(arrival), "stored_at"))
    rows = rows.withColumn("late", F.coalesce(F.max(F.col("before") > F.col("at_ms")).over(of_listing), F.lit(False)))
    previous = F.coalesce(F.lag("price").over(arrival), "stored_price")  # in order, each arrival is the latest one
    changed = rows.where("NOT late").withColumn("previous_price", previous).where("previous_price IS NULL OR previous_price <> price")
    changed = changed.select("listing_id", "seq", "at_ms", "price", "previous_price", (F.col("price") - F.col("previous_price")).alias("price_change"))
    late = rows.where("late").select("listing_id", "seq", "at_ms", "price", "stored_at", "stored_price")
    late = late.repartition("listing_id").sortWithinPartitions("listing_id", "seq", "at_ms", "price")
    appended = changed.unionByName(late.mapInArrow(_fold, HISTORY))
    last = F.max_by(F.struct("seq", "price", "previous_price", "price_change"), "seq").alias("r")
    return appended.groupBy("listing_id", "at_ms").agg(last).select("listing_id", "at_ms", F.col("at_ms").cast("string").alias("history_id"), "r.*")


def merge_history(history: DataFrame, appended: DataFrame) -> DataFrame:
    """History with appended rows, which replace those of the same millisecond."""
    kept = history.join(appended.select("listing_id", "at_ms"), ["listing_id", "at_ms"], "left_anti")
    return kept.unionByName(appended.select(history.columns))
