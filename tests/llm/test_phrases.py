"""Collocations against a count of all phrases in memory."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.llm import phrases as p
from tidewell.llm.queries import QUERIES, SQL

from .conftest import DOCUMENT

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, top):
    """lang -> rows (phrase, a, l, r, n, score) in order."""
    f: dict[str, Counter] = {}
    n: Counter = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = {}
    for lang, counts in f.items():
        candidates = {w: a for w, a in counts.items() if len(w) > 1 and a >= least}
        kept = []
        for w, a in candidates.items():
            inside = lambda x, w=w: any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))
            if any(len(x) > len(w) and 100 * b >= 50 * a and inside(x) for x, b in candidates.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[w[:k]] * counts[w[k:]]), k, counts[w[:k]], counts[w[k:]]) for k in range(1, len(w)))
            kept.append((" ".join(w), a, left, right, n[lang], score))
        kept.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        if kept:
            found[lang] = kept[:top]
    return found


def some_rows(seed=3):
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "river", "Äpfel", "äpfel", "한국", "the", "of", "a", "x" * 300]
    rows = [(None, "en"), ("", None), (" \t ", "en"), ("one", "en"), ("..;", "fr")]
    for _ in range(250):
        text = ""
        for _ in range(rng.randint(1, 60)):
            text += rng.choice(["New York City", "the river of", *words]) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " "])
        rows.append((text, rng.choice(["en", "en", "de", None, "und", ""])))
    return rows + rows[-20:] * 2


def found(df):
    out: dict[str, list] = {}
    for r in sorted(df.collect(), key=lambda r: (r.lang, r.rank)):
        out.setdefault(r.lang, []).append((r.phrase, r.a, r.l, r.r, r.n, r.score))
        assert r.rank == len(out[r.lang])
    return out


@pytest.mark.parametrize(("bits", "flush", "longest", "top"), [(20, 200_000, 3, 2000), (4, 7, 3, 5), (12, 1, 2, 50), (16, 50, 4, 2000)])
def test_equals_brute_force(spark, scratch, bits, flush, longest, top):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = found(p.phrases(docs, scratch, least=5, longest=longest, top=top, bits=bits, flush=flush))
    want = brute(rows, 5, longest, top)
    assert got == want and sum(map(len, want.values())) > 15


def test_buffers_lose_and_repeat_nothing():
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "bb", "ccc", " ", " ", "\t", ".", "\n", "w" * 40]) for _ in range(rng.randint(0, 300))).encode() for _ in range(60)]
    texts += [b"word " * 100, b"x" * 500, b" " * 500, b"a b " + b"y" * 300 + b" c d " * 30, b"", b"." * 100]
    for size in (3, 10, 64, 1000):
        for carried in (1, 2, 3):
            counts: dict[int, Counter] = {k: Counter() for k in range(1, carried + 2)}
            want: dict[int, Counter] = {k: Counter() for k in range(1, carried + 2)}
            for buffer, done in p.buffers(texts, carried, size):
                words = p.Words("en", buffer)
                for k, total in counts.items():
                    for value, n in zip(*(x.to_pylist() for x in words.counted(k, words.whole(k, done))), strict=True):
                        total[value] += n
            for text in texts:
                for piece in re.split(rb"[.,;:!?\x0a-\x0d]", text):
                    words = re.findall(rb"[^\x20\x09]+", piece)
                    for k, total in want.items():
                        total.update(b"".join(w + b" " for w in words[i : i + k]) for i in range(len(words) - k + 1))
            assert counts == want, (size, carried)


def test_pruning_counts_little_that_is_rare(spark, scratch):
    """Of two words that stand together once nearly none is counted exactly."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(" ".join(f"w{rng.randint(0, 400)}" for _ in range(2000)) + " again and again" * 3, "en") for _ in range(20)], "text string, lang string")
    rows = docs.mapInArrow(p._pass(2, 3, 22, _maps(spark, docs, scratch), 10**6), p.PARTS).where("phrase IS NOT NULL")
    pairs = docs.select(F.explode(F.split("text", " "))).count()
    assert rows.agg(F.sum("n")).first()[0] < pairs / 20


def _maps(spark, docs, scratch):
    parts = scratch.cut(docs.mapInArrow(p._pass(1, 3, 22, [None, None], 10**6), p.PARTS).groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n")).where("n >= 10"), "first")
    frequent = parts.where("phrase IS NOT NULL").mapInArrow(p._buckets_of(1, 22), "bucket bigint")
    return [spark.sparkContext.broadcast(p.bitmap(x, 22)) for x in (frequent, parts.where("phrase IS NULL").select("bucket"))]


def test_bucket_counts_go_in_one_row_for_each_range(spark, scratch):
    """However many pairs a task meets; and the buckets follow the size of the texts."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(" ".join(f"w{rng.randint(0, 300)}" for _ in range(3000)) + " hot pair" * 12, "en") for _ in range(20)], "text string, lang string").repartition(2)
    packed = scratch.cut(docs.mapInArrow(p._packed(1, 3, 22, [None, None], 200_000, 10), p.PACKED), "packed").where("phrase IS NULL")
    each = docs.mapInArrow(p._pass(1, 3, 22, [None, None], 200_000), p.PARTS).where("phrase IS NULL").groupBy("bucket").agg(F.sum("n").alias("n"))
    assert packed.count() <= 2 * 2 ** (22 - p.RANGE) and each.count() > 20_000
    hot = each.where("n >= 10").select("bucket")
    assert p.hot_buckets(packed, 22, 10) == p.bitmap(hot, 22) and not hot.isEmpty()
    sizes = [p.buckets_for(spark.range(n).select(F.lit("x" * 2**20).alias("text"))) for n in (0, 1, 2048, 8192, 40_000)]
    assert sizes == [p.BITS, p.BITS, 27, p.MOST_BITS, p.MOST_BITS]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10**12
    counts = [spark.createDataFrame([("en", "a", big), ("en", "b", big + 7)], "lang string, phrase string, n bigint"), spark.createDataFrame([("en", "a b", big - 11)], "lang string, phrase string, n bigint")]
    r = p.scored(counts).first()
    assert (r.a, r.l, r.r, r.score) == (big - 11, big, big + 7, 1_000_000 * (big - 11) ** 2 // (big * (big + 7)))


def test_first_of_each_spreads_a_key(spark, scratch):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(9).alias("k"), (F.col("id") * 7919 % 1009).alias("v"), "id")
    got = p.first_of_each(rows, "k", [F.desc("v"), F.asc("id")], 100, scratch).collect()
    want = {}
    for i in range(3000):
        want.setdefault(i % 3 if i % 10 == 0 else 9, []).append((-(i * 7919 % 1009), i))
    want = {(k, n): i for k, xs in want.items() for n, (_, i) in enumerate(sorted(xs)[:100], 1)}
    assert {(r.k, r["rank"]): r.id for r in got} == want


def test_odd_tables(spark, scratch, odd, clashing, nothing):
    assert p.phrases(nothing, scratch).isEmpty()
    rows = [(r.text, r.lang) for r in odd.collect()]
    for docs in (odd, clashing):
        assert found(p.phrases(docs, p.Scratch(spark), least=4, bits=14)) == brute(rows, 4, 3, 2000)
    one = spark.createDataFrame([(None, "just a few words", None, None, 1)], DOCUMENT)
    assert p.phrases(one, p.Scratch(spark)).isEmpty()


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = QUERIES["op11_phrases"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL['op11_phrases']})").fetchall())
