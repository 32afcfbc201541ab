from collections import defaultdict

from tidewell.llm.scratch import Scratch
from tidewell.llm.sharding import BITS, shard

from .conftest import odd_rows


def check(got, limit):
    held, rows = defaultdict(int), defaultdict(int)
    for r in got:
        held[r.shard] += r.bytes
        rows[r.shard] += 1
    for r in got:
        assert r.shard_bytes == held[r.shard] and r.shard_rows == rows[r.shard]
        assert r.shard_bytes <= limit or (r.shard_rows == 1 and r.bytes > limit), r
    names = [s[1:] for s in held if "." not in s]
    assert not any(a != b and b.startswith(a) for a in names for b in names)  # a prefix code
    for s in names:  # only an oversized bucket was split
        if s:
            assert sum(n for k, n in held.items() if k[1:].startswith(s[:-1])) > limit
    return len(held)


def test_odd_rows(odd, spark):
    for limit in (1 << 20, 4000, 300):
        got = shard(odd, Scratch(spark), limit=limit).collect()
        assert len(got) == len(odd_rows())
        n = check(got, limit)
        assert (n == 1) == (limit == 1 << 20)


def test_one_hash_over_the_limit(spark, scratch):
    docs = spark.createDataFrame([(1, "same text")] * 1000 + [(i, "other") for i in range(2, 50)], "doc_id bigint, text string").repartition(6)
    got = shard(docs, scratch, limit=100).collect()
    check(got, 100)
    assert len(got) == 1048 and len({r.shard for r in got if "." in r.shard}) == -(-1000 // (100 // 9))
    assert all(len(r.shard) > BITS for r in got if "." in r.shard)


def test_rows_without_bytes(spark, scratch):
    docs = spark.createDataFrame([(None, None)] * 5 + [(1, "")], "doc_id bigint, text string")
    assert {r.shard for r in shard(docs, scratch, limit=10).collect()} == {"/"}


def test_empty(nothing, scratch):
    assert shard(nothing, scratch).count() == 0


def test_clashing_names(clashing, scratch):
    got = shard(clashing, scratch, carry=clashing.columns, limit=4000)
    assert got.count() == len(odd_rows()) and got.where("part = 'own'").count() == len(odd_rows())
