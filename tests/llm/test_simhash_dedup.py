import random

import xxhash

from tidewell.llm.components import connected_components
from tidewell.llm.simhash_dedup import RADIUS, _masks, links, near_duplicates

from .conftest import odd_rows, prose


def brute_fingerprint(text: str) -> int:
    words, word = [], []
    for c in (text or "") + " ":  # A-Z and the six ASCII blanks, nothing else
        if c in " \t\n\x0b\x0c\r":
            words += ["".join(word)] if word else []
            word = []
        else:
            word.append(chr(ord(c) + 32) if "A" <= c <= "Z" else c)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: dict) -> dict:
    """The smallest id reachable, over all pairs."""
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= RADIUS and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_masks_cover_every_pair_in_the_radius():
    rng = random.Random(1)
    for _ in range(3000):
        bits = rng.sample(range(64), rng.randint(0, RADIUS))
        difference = sum(1 << b for b in bits)
        assert any(difference & m == 0 for m in _masks())


def test_against_brute_force(spark, scratch):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        text = prose(rng, rng.choice([3, 20, 60, 200]))
        rows.append((10 * i, text))
        for j in range(rng.randint(0, 4)):
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            rows.append((10 * i + 1 + j, " ".join(words)))
    fps = {i: brute_fingerprint(t) for i, t in rows}
    expected = brute_components(fps)
    for bucket in (512, 1):  # the second sends every bucket the exact second way
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = near_duplicates(docs, type(scratch)(spark), bucket=bucket).collect()
        assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
        assert {r.doc_id: r.component_id for r in got} == expected
        assert sum(r.first for r in got) == len(set(expected.values()))


def test_odd_rows(odd, scratch):
    got = near_duplicates(odd, scratch).collect()
    assert len(got) == len(odd_rows())
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, text, *_ in odd_rows():
        if i is not None:
            assert int(by_id[i].fingerprint, 16) == brute_fingerprint(text), i
    assert by_id[1].component_id == by_id[2].component_id == by_id[3].component_id == 1
    assert by_id[4].fingerprint == by_id[5].fingerprint == by_id[6].fingerprint == "0" * 16
    assert {by_id[i].component_id for i in (4, 5, 6)} == {4}
    firsts = [r.component_id for r in got if r.first]
    assert len(firsts) == len(set(firsts))


def test_close_fingerprints_in_a_large_bucket(spark, scratch):
    base = 0x0123456789ABCDEF
    words = [base] + [base ^ (1 << i) ^ (1 << (i + 7)) for i in range(0, 50, 3)] + [base ^ (0xFFFF << 20)]
    nodes = spark.createDataFrame([(w,) for w in words], "fp bigint")
    roots = {r.node: r.root for r in connected_components(links(nodes, scratch, bucket=2), scratch).collect()}
    near = {w for w in words if (w ^ base).bit_count() <= RADIUS}
    assert roots == {w: min(near) for w in near if w != min(near)}


def test_rows_of_the_tables_are_never_broadcast(spark, scratch, tmp_path):
    plans = {}

    class Seen(type(scratch)):
        def cut(self, df, name):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return super().cut(df, name)

    spark.range(2000).selectExpr("xxhash64(id) AS fp").unionAll(spark.range(2000).selectExpr("xxhash64(id) ^ 1 AS fp")).write.parquet(f"{tmp_path}/nodes")
    found = links(spark.read.parquet(f"{tmp_path}/nodes"), Seen(spark))  # of so few bytes that Spark would broadcast any side
    assert "Broadcast" not in plans["buckets"] and "SortMergeJoin" in plans["buckets"]
    assert found.select("a").distinct().count() == 2000


def test_chain_of_components(spark, scratch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(edges, scratch).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {201: 200}


def test_empty(nothing, scratch):
    assert near_duplicates(nothing, scratch).count() == 0


def test_clashing_names(clashing, scratch):
    got = near_duplicates(clashing, scratch, carry=clashing.columns)
    assert got.count() == len(odd_rows()) and got.where("keep_id = 'own'").count() == len(odd_rows())
