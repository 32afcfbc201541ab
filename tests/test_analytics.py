"""Statistics, windows and states against loops; one key holds most rows, and some keys, prices or times are missing."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.operators import analytics, history

ROW = "id bigint, key string, price bigint, at timestamp, seller string"


def rows_of(seed, n):
    r = random.Random(seed)
    some = lambda x: None if r.random() < 0.05 else x
    start = datetime(2023, 12, 30)
    return [
        (i, some("hot" if r.random() < 0.6 else f"k{r.randint(0, 6)}"), some(r.choice([5, 5, 7, 9, 30])), some(start + timedelta(days=r.randint(0, 900))), some(f"s{r.randint(0, 3)}"))
        for i in range(n)
    ]


def by_key(rows):
    found = {}
    for row in rows:
        found.setdefault(row[1], []).append(row)
    return found


def test_price_stats(spark):
    rows = rows_of(1, 400) + [(400, "no price", None, None, None)]
    got = {r.key: r for r in analytics.price_stats(spark.createDataFrame(rows, ROW), ["key"], "price", "at", "id", "seller").collect()}
    for key, own in by_key(rows).items():
        prices, r = [x[2] for x in own if x[2] is not None], got.pop(key)
        assert r.observations == len(own) and r.sellers == len({x[4] for x in own} - {None})
        assert r.median_price == (statistics.median(prices) if prices else None)
        assert r.avg_price == (pytest.approx(statistics.mean(prices)) if prices else None)
        assert (r.min_price, r.max_price) == ((min(prices), max(prices)) if prices else (None, None))
    assert not got


def test_percentile_of(spark):
    rows = rows_of(2, 300)
    got = {r.id: r.percentile for r in analytics.percentile_of(spark.createDataFrame(rows, ROW), "key", "price").collect()}
    at = lambda price: float("-inf") if price is None else price
    groups = by_key(rows)
    assert got == {i: sum(at(x[2]) <= at(price) for x in groups[key]) / len(groups[key]) for i, key, price, _, _ in rows}


def test_rolling_looks_back_over_the_ends_of_stretches(spark):
    rows = rows_of(3, 300)
    df = analytics.rolling(spark.createDataFrame(rows, ROW), "key", "at", "price", (1, 30))
    assert df.columns == ["id", "key", "price", "at", "seller", "min_1d", "min_30d", "avg_1d", "avg_30d"]
    got, groups = {r.id: r for r in df.collect()}, by_key(rows)
    assert len(got) == len(rows)
    for i, key, _, at, _ in rows:
        for n in (1, 30):
            near = [x[2] for x in groups[key] if (x[3] is None if at is None else x[3] is not None and at - timedelta(days=n) <= x[3] <= at)]
            near = [x for x in near if x is not None]
            assert got[i][f"min_{n}d"] == min(near, default=None)
            assert got[i][f"avg_{n}d"] == (pytest.approx(statistics.mean(near)) if near else None)


def test_a_hot_key_is_spread_over_its_stretches(spark):
    days = spark.range(4000).select(F.lit("hot").alias("key"), F.timestamp_seconds(F.col("id") * 86_400).alias("at"), F.col("id").alias("price"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = analytics.rolling(days, "key", "at", "price", (30,)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and sum(r["count"] for r in tasks) == 4000


@pytest.mark.parametrize("start, end", [(0, 40), (10, 20)])
def test_unseen(spark, start, end):
    r = random.Random(start)
    time = lambda lo, hi: datetime(2024, 1, 1) + timedelta(days=r.randint(lo, hi), hours=r.choice([0, 7, 23]))
    seen = [(r.choice(["m", "m", "n", "none", None]), f"l{r.randint(0, 80)}", None if r.random() < 0.1 else time(0, 40)) for _ in range(300)]
    jobs = [(r.choice(["m", "n", None]), None if r.random() < 0.1 else time(start, end)) for _ in range(60)]
    got = analytics.unseen(spark.createDataFrame(seen, "mall_id string, listing_id string, crawled_at timestamp"), spark.createDataFrame(jobs, "mall_id string, started_at timestamp"))
    last = {}
    for mall, listing, at in seen:
        known = last.get((mall, listing))
        last[mall, listing] = at if known is None else known if at is None else max(known, at)
    want = {k: 0 if at is None or k[0] is None else sum(m == k[0] and s is not None and s >= at for m, s in jobs) for k, at in last.items()}
    assert {(x.mall_id, x.listing_id): x.jobs_since for x in got.collect()} == want and len(set(want.values())) > 4


def folded(rows, stored):
    """The rule, one arrival after the other."""
    found = {}
    for name, seq, at, price in sorted(rows, key=lambda x: (x[0], x[1])):
        if at is None or price is None:
            continue
        latest, current = stored.get(name, (None, None))
        if price == current:
            continue
        found[name, at] = (seq, price, current)
        if latest is None or at >= latest:
            stored[name] = (at, price)
    return found


def test_replay_of_listings_in_order_and_late_ones(spark):
    r = random.Random(9)
    late = lambda k: r.choice([0, 0, -35, 60]) if k % 3 == 0 else 0
    rows = [(f"l{k}", i, (i * 10 + late(k)) // 20, r.choice([None, 5, 5, 6, 7])) for k in range(30) for i in range(40)]
    kind = "listing_id string, seq bigint, at_ms bigint, price bigint"
    early, later = ([x for x in rows if (x[1] < 15) == first] for first in (True, False))
    plain = lambda df: {(x.listing_id, x.at_ms): (x.seq, x.price, x.previous_price) for x in df.collect()}
    stored = {}
    first = history.replay(spark.createDataFrame(early, kind))
    assert plain(first) == folded(early, stored)
    assert plain(history.replay(spark.createDataFrame(later, kind), latest=history.latest_stored(first))) == folded(later, stored)
    assert history.replay(spark.createDataFrame([], kind)).isEmpty()
