"""The audit of sources against dictionaries in memory."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.llm import divergence as d
from tidewell.llm.queries import QUERIES, SQL
from tidewell.llm.scratch import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    texts = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    found = set()
    for lang in {x[0] for x in texts}:
        mine = [x for x in texts if x[0] == lang]
        held = Counter(t for _, _, terms in mine for t in set(terms))
        kept = sorted(t for t, n in held.items() if n >= least)
        groups: dict[str, Counter] = {s: Counter() for _, s, _ in mine}
        for _, source, terms in mine:
            groups[source].update(t for t in terms if held[t] >= least)
        whole = sum(groups.values(), Counter())
        shares = {s: {t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept)) for t in kept} for s, c in [*groups.items(), (None, whole)]}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in groups.items():
            pairs = [(-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-f(shares[s][t], shares[None][t]), t.encode()) for t in kept if c[t] > 0 and shares[s][t] > shares[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(items)[:most], 1):
                    found.add((lang, s, part, item.decode(), -value, rank))
    return found


def some_rows(seed=1):
    rng = random.Random(seed)
    words = ["The", "the", "river", "ÄRGER", "ärger", "don't", "x2y", "한국어", "naïve", "İ", "a", "B", "c_d", "ß"] + [f"w{i}" for i in "abcdefghij"]
    rows = [(None, "en", "s1"), ("", None, None), ("123 _ {}", "none", "empty"), ("few words here", "rare", "s1"), (None, "rare", "s2"), (None, "rare", None), ("  ", "alone", "s")]
    for _ in range(300):
        some = words if rng.random() < 0.5 else words[:8]
        text = "".join(rng.choice(some) + rng.choice([" ", ", ", "\n", "1", "_", "[", "\x7f", " "]) for _ in range(rng.randint(0, 40)))
        rows.append((text, rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "ß", "", None])))
    return rows + rows[-15:]


def shown(df):
    rows = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("least", "top", "slices"), [(10, 10, 1024), (3, 2, 1), (1, 1000, 7)])
def test_equals_brute_force(spark, least, top, slices):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got, want = shown(d.divergence(docs, Scratch(spark), least, top, slices)), brute(rows, least, top)
    assert got == want and {x[2] for x in want} == {"pair", "term"} and any(x[0] == "rare" for x in want)


def test_shares_and_distances_are_exact_beyond_64_bits(spark):
    n, total, v = 7 * 10**15, 9 * 10**15 + 1, 123_456
    row = spark.createDataFrame([(n, total, v)], "n bigint, total bigint, v bigint").select(d.share("n", "total", "v").alias("p"), F.lit(1).cast("bigint").alias("q"))
    p = 1 + 10**9 * (n + 2) // (total + 2 * v)
    assert row.select("p", d.distance("p", "q").alias("f")).first() == (p, (p - 1) ** 2 // (p + 1))
    widest = spark.createDataFrame([(10**9 + 1, 1)], "p bigint, q bigint").select(d.distance("p", "q").alias("f")).first().f
    assert widest == (10**9) ** 2 // (10**9 + 2)


def test_odd_tables(spark, odd, clashing, nothing):
    assert d.divergence(nothing, Scratch(spark)).isEmpty()
    want = brute([(r.text, r.lang, r.source) for r in odd.collect()], 2, 10)
    assert shown(d.divergence(odd, Scratch(spark), least=2)) == want == shown(d.divergence(clashing, Scratch(spark), least=2))


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = QUERIES["op12_divergence"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL['op12_divergence']})").fetchall())
