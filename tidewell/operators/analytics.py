"""Price statistics, windows in time, trend and purchase signals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_stats(rows: DataFrame, key: list[str], price: str, time: str, tie: str, seller: str) -> DataFrame:
    """AGG-6, 7, 8, 10, 11 for each key: exact median, range, change between first and last, sellers.

    Rows are first added up by key, seller and price, so that what follows is as
    large as a key's prices.  The median is read off running counts in the order
    of prices, and a seller counts at the first of its prices: windows that
    spill, in place of buffers that hold all prices or sellers of a key.
    """
    p, n, order = F.col(price), F.col("_n"), F.struct(time, tie)
    ends = [F.min(F.struct(order.alias("o"), p.alias("p"))).alias("_first"), F.max(F.struct(order.alias("o"), p.alias("p"))).alias("_last")]
    by_price = rows.groupBy(*dict.fromkeys([*key, seller, price])).agg(F.count(F.lit(1)).alias("_n"), *ends)
    priced, of_key = F.when(p.isNotNull(), n), Window.partitionBy(*key)
    by_price = by_price.withColumns({
        "_new": F.when(F.col(seller).isNotNull(), (F.row_number().over(Window.partitionBy(*dict.fromkeys([*key, seller])).orderBy(p)) == 1).cast("bigint")),
        "_upto": F.sum(priced).over(of_key.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)),
        "_middle": (F.sum(priced).over(of_key) - 1) / 2,
    })
    first, last = F.min("_first")["p"], F.max("_last")["p"]
    low, high = (F.min(F.when(F.col("_upto") > at, p)).cast("double") for at in (F.floor("_middle"), F.ceil("_middle")))
    return by_price.groupBy(*key).agg(
        F.min(p).alias("min_price"), F.max(p).alias("max_price"), F.try_divide(F.sum(p * n), F.sum(priced)).alias("avg_price"),
        (low * 0.5 + high * 0.5).alias("median_price"), (F.max(p) - F.min(p)).alias("price_range"),
        F.try_divide(last - first, first).alias("change_rate"), F.coalesce(F.sum("_new"), F.lit(0)).alias("sellers"), F.sum(n).alias("observations"),
    )


def percentile_of(rows: DataFrame, key: str, price: str) -> DataFrame:
    """AGG-9: the share of a key's prices at or under each price.

    Each price of a key is counted first and stands in the window once; the
    shares meet the rows by key and price.
    """
    counts = rows.groupBy(F.col(key).alias("_key"), F.col(price).alias("_price")).agg(F.count(F.lit(1)).alias("_n"))
    of_key = Window.partitionBy("_key")
    upto = F.sum("_n").over(of_key.orderBy("_price").rowsBetween(Window.unboundedPreceding, 0))
    shares = counts.select("_key", "_price", (upto / F.sum("_n").over(of_key)).alias("percentile"))
    met = F.col(key).eqNullSafe(F.col("_key")) & F.col(price).eqNullSafe(F.col("_price"))
    return rows.drop("percentile").join(shares, met).drop("_key", "_price")


def rolling(rows: DataFrame, key: str, time: str, price: str, days: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """WIN-4: minimum and mean of the last n days, this row included.

    Time is cut into stretches of four of the longest periods, and a key's rows
    are ordered within one; the rows of a stretch's last period stand in the next
    one, too, as what its first rows look back on.
    """
    seconds, longest = F.unix_timestamp(F.col(time).cast("timestamp")), max(days) * 86_400
    stretch = F.floor(seconds / (4 * longest))
    ahead = F.when(F.floor((seconds + longest) / (4 * longest)) > stretch, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("_ahead", F.explode(ahead))
    of_key = Window.partitionBy(key, stretch + F.col("_ahead")).orderBy(seconds)
    frames = {n: of_key.rangeBetween(-n * 86_400, 0) for n in days}
    found = rows.withColumns(
        {f"min_{n}d": F.min(price).over(w) for n, w in frames.items()} | {f"avg_{n}d": F.avg(price).over(w) for n, w in frames.items()}
    )
    return found.where("_ahead = 0").drop("_ahead")


def trend(rows: DataFrame, key: str, time: str, price: str, least: int = 5, slope: float = 0.002, wild: float = 0.6) -> DataFrame:
    """WIN-5: UNKNOWN under `least` points, VOLATILE from a relative deviation of `wild`, else by the relative slope a day."""
    day = F.unix_timestamp(F.col(time).cast("timestamp")) / 86_400
    stats = rows.groupBy(key).agg(
        F.count(price).alias("points"), F.avg(price).alias("mean"), F.stddev_samp(price).alias("deviation"), F.regr_slope(F.col(price), day).alias("slope")
    )
    relative = F.try_divide(F.col("slope"), F.col("mean"))
    label = (
        F.when((F.col("points") < least) | relative.isNull(), "UNKNOWN")
        .when(F.try_divide(F.col("deviation"), F.col("mean")) >= wild, "VOLATILE")
        .when(relative >= slope, "UP").when(relative <= -slope, "DOWN").otherwise("STABLE")
    )
    return stats.select(key, "points", label.alias("trend"))


def signal(current: Column, lowest: Column, mean: Column, near: float = 1.1, dear: float = 1.2) -> Column:
    """WIN-6: BUY within `near` of the lowest, AVOID from `dear` times the mean, else WAIT."""
    return F.when(current <= lowest * near, "BUY").when(current >= mean * dear, "AVOID").otherwise("WAIT")


def histogram(rows: DataFrame, price: str, low: float, high: float, bins: int) -> DataFrame:
    """AGG-12: counts of equal bins; 0 and bins + 1 are outside."""
    return rows.select(F.width_bucket(price, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def daily_series(rows: DataFrame, key: str, time: str, tie: str, price: str) -> DataFrame:
    """AGG-14: the last price of each day."""
    day = F.to_date(time).alias("day")
    return rows.groupBy(key, day).agg(F.max_by(price, F.struct(time, tie)).alias("close_price"), F.count(F.lit(1)).alias("observations"))


def anomalies(rows: DataFrame, key: str, price: str, factor: float = 3.0) -> DataFrame:
    """VAL-16: rows over `factor` times their key's median, or under its `factor`-th part."""
    median = rows.groupBy(key).agg(F.median(price).alias("median_price"))
    odd = (F.col(price) > F.col("median_price") * factor) | (F.col(price) * factor < F.col("median_price"))
    return rows.join(median, key).where(odd)


def unseen(listings: DataFrame, jobs: DataFrame, time: str = "crawled_at", missing: int = 3, gone: int = 10) -> DataFrame:
    """WIN-8: listings by how many jobs of their mall began since they were seen: UNAVAILABLE from `missing`, DISCONTINUED from `gone`.

    A mall is one row with an entry for every day from its first start to its
    last: the starts of later days as a number and its own as times.  A listing
    reads the entry of the day when it was last seen, so that listings never
    meet.  Starts are few (a crawl a mall a few times a day); Spark broadcasts
    the malls while they are small and joins by mall beyond.  A listing without
    any time of being seen, or of a mall without starts, counts none.
    """
    seen = listings.groupBy("mall_id", "listing_id").agg(F.max(time).alias("last_seen_at"))
    by_day = jobs.where(F.col("started_at").isNotNull()).groupBy("mall_id", F.unix_date(F.to_date("started_at")).alias("day")).agg(F.collect_list("started_at").alias("starts"))
    days = by_day.groupBy("mall_id").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day")).join(by_day, ["mall_id", "day"], "left")
    later = F.sum(F.size(F.coalesce("starts", F.array()))).over(Window.partitionBy("mall_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1))
    entry = F.struct("day", F.coalesce(later, F.lit(0)).alias("later"), F.coalesce("starts", F.array()).alias("starts"))
    malls = days.select("mall_id", entry.alias("entry")).groupBy("mall_id").agg(F.sort_array(F.collect_list("entry")).alias("days"))

    first, at = F.col("days")[0], F.unix_date(F.to_date("last_seen_at")) - F.col("days")[0]["day"]
    own = F.get("days", at)
    since = own["later"] + F.size(F.filter(own["starts"], lambda start: start >= F.col("last_seen_at")))
    since = F.when(at < 0, first["later"] + F.size(first["starts"])).when(at < F.size("days"), since).otherwise(F.lit(0))
    counted = seen.join(malls, "mall_id", "left").withColumn("since", F.coalesce(since, F.lit(0)).cast("bigint"))
    state = F.when(F.col("since") >= gone, "DISCONTINUED").when(F.col("since") >= missing, "UNAVAILABLE").otherwise("AVAILABLE")
    return counted.select("mall_id", "listing_id", "last_seen_at", F.col("since").alias("jobs_since"), state.alias("status"))


def repeated_prices(rows: DataFrame, key: str, time: str, price: str) -> DataFrame:
    """VAL-16: records of one key, time and price that were stored more than once, with how often."""
    return rows.groupBy(key, time, price).agg(F.count(F.lit(1)).alias("records")).where("records > 1")


def deals(stats: DataFrame, change: str, key: str, n: int) -> DataFrame:
    """WIN-9: the n largest drops."""
    return stats.where(F.col(change) < 0).orderBy(change, key).limit(n)


def similar(rows: DataFrame, key: str, vector: str, queries: DataFrame, least: float, block: int = 4096) -> DataFrame:
    """IDN-9: pairs (query, key, cosine) of any number of queries against all rows, by matrix products of blocks."""

    def blocks(df: DataFrame, name: str, own: str, others: str, n_own: int, n_others: int) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        df = df.select(F.col(key).alias(name), v.alias("v"), F.size(v).alias("size"), F.pmod(F.xxhash64(key), F.lit(n_own)).alias(own))
        df = df.where(~F.exists("v", lambda x: x.isNull()) & F.exists("v", lambda x: x != 0))
        return df.withColumn(others, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_others - 1).cast("bigint"))))

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v = (np.array(t["v"].combine_chunks().flatten()).reshape(len(t), -1) for t in (left, right))
        q, v = (x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x for x in (q, v))
        at, to, cosine = [], [], []
        for i in range(0, len(q) if len(v) else 0, 256):
            found = q[i : i + 256] @ v.T
            x, y = np.nonzero(found >= least)
            at.append(x + i), to.append(y), cosine.append(found[x, y])
        at, to = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (at, to))
        cosine = pa.array(np.concatenate(cosine) if cosine else np.zeros(0), pa.float64())
        return pa.table({"query": left["query"].take(pa.array(at)), key: right["row_key"].take(pa.array(to)), "cosine": cosine})

    n_queries, n_rows = (max(1, -(-df.count() // block)) for df in (queries, rows))
    left = blocks(queries, "query", "qb", "rb", n_queries, n_rows).groupBy("size", "qb", "rb")
    right = blocks(rows, "row_key", "rb", "qb", n_rows, n_queries).groupBy("size", "qb", "rb")
    kind = rows.schema[key].dataType.simpleString()
    found = left.cogroup(right).applyInArrow(product, f"query {kind}, `{key}` {kind}, cosine double")
    return found.where(F.col("query") != F.col(key))
