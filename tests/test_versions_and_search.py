"""Change feeds, sketches, gram postings and groups of several sources, each against a plain computation."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import changes, clusters, search, sketches


# ---- change feeds ------------------------------------------------------------
OLD = [("a", None, 1, "x"), ("b", 1, 2, "y"), (None, 1, 3, None), ("gone", 0, 4, "z"), ("same", 9, 5, None)]
NEW = [("a", None, 1, None), ("b", 1, 7, "w"), (None, 1, 3, "now"), ("new", 0, 4, "z"), ("same", 9, 5, None)]
ROW = "k string, l int, v int, w string"


def test_changes(spark):
    feed = changes.changes(spark.createDataFrame(OLD, ROW), spark.createDataFrame(NEW, ROW), ["k", "l"])
    got = {(r.k, r.l): (r.change, r.changed, r.old and tuple(r.old), r.new and tuple(r.new)) for r in feed.collect()}
    assert got == {
        ("a", None): ("CHANGED", ["w"], (1, "x"), (1, None)), ("b", 1): ("CHANGED", ["v", "w"], (2, "y"), (7, "w")), (None, 1): ("CHANGED", ["w"], (3, None), (3, "now")),
        ("gone", 0): ("REMOVED", [], (4, "z"), None), ("new", 0): ("INSERTED", [], None, (4, "z")),
    }
    assert {(r.change, r.column): r.rows for r in changes.summary(feed).collect()} == {("CHANGED", "w"): 3, ("CHANGED", "v"): 1, ("REMOVED", None): 1, ("INSERTED", None): 1}


def test_columns_of_one_version_and_ignored_ones(spark):
    old, new = spark.createDataFrame([(1, 2, 3), (4, 5, 6)], "k int, a int, b int"), spark.createDataFrame([(1, 9, "x"), (4, 0, None)], "k int, a int, c string")
    got = {r.k: (r.change, r.changed) for r in changes.changes(old, new, ["k"], ignore=["a"]).collect()}
    assert got == {1: ("CHANGED", ["b", "c"]), 4: ("CHANGED", ["b"])}
    assert changes.changes(old, old, ["k"]).isEmpty() and changes.changes(old.limit(0), old.limit(0), ["k"]).isEmpty()
    assert changes.changes(old.limit(0), old, ["k"]).where("change = 'INSERTED'").count() == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_a_version_made_from_its_changes(spark, seed):
    rng = random.Random(seed)
    version = lambda: spark.createDataFrame([(k, rng.choice([None, 1, 2]), rng.choice(["a", None])) for k in rng.sample(range(60), 40)] + [(None, 1, "n")][: rng.randint(0, 1)], "k int, v int, w string")
    old, new = version(), version()
    made = changes.apply_changes(old, changes.changes(old, new, ["k"]), ["k"])
    assert sorted(map(str, made.select("k", "v", "w").collect())) == sorted(map(str, new.collect()))


# ---- sketches ----------------------------------------------------------------
def test_merged_days_are_as_one_sketch_within_the_bounds(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"),
        F.expr("date_add(DATE '2026-01-01', CAST(id % 31 AS INT))").alias("at"), (F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("price"), (F.col("id") % 5000).alias("seller"),
    )
    days = sketches.daily(rows.unionAll(rows.limit(1).select(F.lit("none"), "at", F.lit(None).cast("bigint"), "seller")), ["key"], "at", "price", "seller")
    assert days.where("key = 'none'").isEmpty() and days.count() == 8 * 31
    january = sketches.statistics(sketches.merged(sketches.between(days, "2026-01-05", "2026-01-20"), ["key"]), (0.1, 0.5, 0.9))
    inside = rows.where("at >= DATE '2026-01-05' AND at < DATE '2026-01-20'")
    exact = {r.key: r for r in inside.groupBy("key").agg(F.count("*").alias("n"), F.avg("price").alias("mean"), F.min("price").alias("low"), F.count_distinct("seller").alias("sellers")).collect()}
    for r in january.collect():
        e = exact[r.key]
        assert (r.observations, r.min_price) == (e.n, e.low) and abs(r.avg_price - e.mean) < 1e-6 and abs(r.seller_count / e.sellers - 1) <= sketches.SELLERS_ERROR
        for q, value in ((0.1, r.q10), (0.5, r.q50), (0.9, r.q90)):
            rank = inside.where((F.col("key") == r.key) & (F.col("price") <= value)).count() / e.n
            assert abs(rank - q) <= sketches.RANK_ERROR + 1 / e.n
    small = sketches.statistics(sketches.daily(rows.limit(50), ["key"], "at", "price", "seller"))
    assert small.where("observations = 1 AND q50 <> min_price").isEmpty() and {r.seller_count for r in small.where("observations = 1").collect()} == {1}


# ---- gram postings -----------------------------------------------------------
def test_contains_equals_a_scan(spark, tmp_path):
    rng = random.Random(4)
    names = ["".join(rng.choice("ab 한") for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, "", "a", "aaaaaaa", "xyz", "aabaab"]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    texts = ["", "a", "ab", "aba", "aab", "aabaab", "a b", "한", "한a", "aaaaaaa", "aaaaaaaa", "xyz", "yz", "none", "bbbb", None]
    search.write(search.postings(rows, "id", "name"), str(tmp_path))
    stored = spark.read.parquet(str(tmp_path))
    want = {(t, i) for t in texts if t is not None for i, n in enumerate(names) if n and t in n}
    got = [tuple(r) for r in search.contains(stored, spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    for t in texts[:-1]:
        assert {r.key for r in search.contains_text(stored, t).collect()} == {i for x, i in want if x == t}


def test_a_search_reads_the_postings_of_its_grams(spark, tmp_path):
    search.write(search.postings(spark.createDataFrame([(1, "small ring")], "id int, name string"), "id", "name"), str(tmp_path))
    plan = search.contains_text(spark.read.parquet(str(tmp_path)), "ll ring")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram, [ing,ll ,rin])]" in plan or "In(gram" in plan


def test_postings_are_never_broadcast(spark, monkeypatch):
    """Few texts are, many meet the postings in a merge join; the rows are the same."""
    rows = spark.range(300).select("id", F.concat(F.lit("small ring "), F.col("id").cast("string")).alias("name"))
    texts = spark.createDataFrame([(t,) for t in ("ring 1", "ll ring", "99", "g", "", "none", None)], "t string")
    want = {(t, i) for t in ("ring 1", "ll ring", "99", "g", "") for i in range(300) if t in f"small ring {i}"}
    for few, joins in ((search.FEW, 0), (0, 3)):
        monkeypatch.setattr(search, "FEW", few)
        found = search.contains(search.postings(rows, "id", "name"), texts, "t")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BuildRight" not in plan and plan.count("BuildLeft") == 4 - joins and plan.count("SortMergeJoin") == joins
        assert sorted(map(tuple, found.collect())) == sorted(want)


# ---- groups of several sources -----------------------------------------------
OFFER = "id bigint, mpn string, model_name string, brand string, gpu_model string, vram_gb int, name string, condition string"


def groups(spark, rows):
    now, reviews = clusters.clusters(spark.createDataFrame(rows, OFFER))
    return {r.id: (r.cluster, r.level) for r in now.collect()}, {tuple(r) for r in reviews.collect()}


def test_levels_join_what_does_not_contradict(spark):
    none = (None,) * 4
    rows = [
        (1, "AB-1", "M1", None, None, 16, "one", None), (2, "ab 1", None, None, None, None, "two", None), (3, None, "m1", None, None, None, "three", None),  # 1-2 by number, 3 by model
        (4, "AB-1", None, None, None, 16, "one", "used"),  # used: alone
        (5, None, None, "ASUS", "RTX 5080", 16, "five", None), (6, None, None, "asus", "rtx5080", 16, "six", None), (7, None, None, "ASUS", "RTX 5080", 16, "seven OC", None),
        (8, None, *none, "same", None), (9, None, *none, " SAME ", None), (10, *none, None, None, None),
        (11, None, "M2", None, None, 8, "x", None), (12, None, "M2", None, None, 12, "y", None), (13, None, "M2", None, None, None, "z", None),  # two memory sizes: none of them
        (14, None, None, None, None, 12, "Y", None),  # joins 12 by name after all
    ]
    got, reviews = groups(spark, rows)
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0), 5: (5, 3), 6: (5, 3), 7: (7, 0), 8: (8, 4), 9: (8, 4), 10: (10, 0), 11: (11, 0), 12: (12, 4), 13: (13, 0), 14: (12, 4)}
    assert reviews == {(2, 11, 11), (2, 11, 12), (2, 11, 13)}


def test_components_of_long_chains_and_hot_keys(spark):
    chain = [(i, f"c{i // 2}") for i in range(60)] + [(i, f"d{(i + 1) // 2}") for i in range(60)]
    hot = [(100 + i, "hot") for i in range(500)] + [(100, "other"), (7000, "other"), (8000, "alone")]
    rng = random.Random(1)
    rows = chain + hot + hot[:30]
    rng.shuffle(rows)
    got = {r.node: r.root for r in clusters.components(spark.createDataFrame(rows, "node int, key string")).collect()}
    assert got == {**{i: 0 for i in range(60)}, **{100 + i: 100 for i in range(500)}, 7000: 100, 8000: 8000}
    assert clusters.components(spark.createDataFrame([], "node int, key string")).isEmpty()
