"""As-of and interval joins against loops, hot keys and odd rows included."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import temporal

SECOND = 1_000_000


def rows_of(seed, n):
    """Half of the rows are of one key; times repeat, and some keys or times are missing."""
    rng = random.Random(seed)
    key = lambda: None if rng.random() < 0.03 else "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 8)}"
    return [(i, key(), None if rng.random() < 0.03 else rng.randint(0, 400)) for i in range(n)]


def timed(spark, rows, value):
    df = spark.createDataFrame(rows, f"{value} bigint, key string, s bigint")
    return df.select(value, "key", F.timestamp_seconds("s").alias("at"))


@pytest.mark.parametrize("width", [7, 50, 10_000])
def test_as_of_equals_a_loop(spark, width):
    left, right = rows_of(1, 300), rows_of(2, 200)
    priced = timed(spark, right, "price").withColumn("price", F.when(F.col("price") % 9 != 0, F.col("price")))
    got = temporal.as_of(timed(spark, left, "id"), priced.withColumn("tie", F.coalesce("price", F.lit(-1))), "key", "at", "at", ["price"], ["tie"], width * SECOND)
    assert got.columns == ["id", "key", "at", "price"]

    def last(key, s):
        known = [(t, -1 if i % 9 == 0 else i) for i, k, t in right if k is not None and k == key and t is not None and s is not None and t <= s]
        return max(known)[1] if known else None

    want = {i: None if (x := last(k, s)) == -1 else x for i, k, s in left}
    assert {r.id: r.price for r in got.collect()} == want and sum(x is not None for x in want.values()) > 100


def test_as_of_spreads_a_hot_key(spark):
    """No window holds more than a bucket of a key, and the buckets before reach it as one row each."""
    rows = spark.range(20_000).select(F.lit("hot").alias("key"), F.timestamp_seconds(F.col("id") * 10).alias("at"), F.col("id").alias("price"))
    found = temporal.as_of(rows.drop("price").where("unix_seconds(at) % 70 = 0"), rows.where("price % 1000 = 1"), "key", "at", "at", ["price"], width=3600 * SECOND)
    assert found.where("price <> floor((unix_seconds(at) / 10 - 1) / 1000) * 1000 + 1").isEmpty()
    assert found.where("price IS NULL").count() == 1  # the first row is before any price
    plan = found._jdf.queryExecution().toString()
    assert "_bucket" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def periods(seed, n, name):
    rng = random.Random(seed)
    found = []
    for i in range(n):
        begins = None if rng.random() < 0.05 else rng.randint(0, 500)
        ends = None if rng.random() < 0.1 else (begins or 0) + rng.choice([-3, 0, 1, 5, 40, 200])
        found.append((i, rng.choice(["a", "a", "b", None]), begins, ends))
    return found


@pytest.mark.parametrize(("width", "key"), [(10, "key"), (1000, "key"), (33, None)])
def test_overlapping_equals_all_pairs(spark, width, key):
    left, right = periods(5, 80, "l"), periods(6, 90, "r")
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} int, key string, b bigint, e bigint").select(
        name, *(["key"] if key else []), F.timestamp_seconds("b").alias("begins"), F.timestamp_seconds("e").alias("ends")
    )
    got = temporal.overlapping(frame(left, "l"), frame(right, "r"), key, width * SECOND)
    far = 10**6
    whole = lambda rows: [(i, k, b, far if e is None else e) for i, k, b, e in rows if b is not None and (e is None or b < e)]
    want = {(i, j) for i, k, b, e in whole(left) for j, m, c, d in whole(right) if (key is None or (k is not None and k == m)) and b < d and c < e}
    pairs = [(r.l, r.r) for r in got.select("l", "r").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 50
    assert "right_begins" in got.columns and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_empty_tables(spark):
    none = timed(spark, [], "id")
    some = timed(spark, [(1, "a", 5)], "price")
    assert temporal.as_of(none, some, "key", "at", "at", ["price"]).isEmpty()
    assert temporal.as_of(some, none, "key", "at", "at", ["id"]).collect()[0].id is None
    p = temporal.valid_periods(some, "key", "at", ["price"])
    assert p.collect()[0].ends is None and temporal.overlapping(p, p.limit(0), "key").isEmpty() and temporal.overlapping(p.limit(0), p.limit(0), "key").isEmpty()
