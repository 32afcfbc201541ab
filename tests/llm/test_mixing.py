import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import zlib
from pyspark.sql import functions as F

from tidewell.llm.mixing import DEFAULT_WEIGHT, MAX_EPOCHS, SEED, WEIGHTS, mix

from .conftest import odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared(budget: int, children: dict, weight) -> dict:
    """Water filling, one full child after the other, in fractions; whole tokens at the end."""
    grant, open_, left = {}, dict(children), budget
    while open_:
        total = sum(weight(k) for k in open_)
        if not total:
            break
        full = [k for k, cap in open_.items() if weight(k) and Fraction(cap, weight(k)) <= Fraction(left, total)]
        if not full:
            break
        k = min(full, key=lambda k: Fraction(open_[k], weight(k)))
        grant[k] = open_.pop(k)
        left -= grant[k]
    total = sum(weight(k) for k in open_)
    return grant | {k: min(max(left * weight(k) // total if total else 0, 0), cap) for k, cap in open_.items()}


def brute(rows, budget=None, weights=WEIGHTS):
    docs = [(i, t or "", lang, source, f"d{zlib.crc32((source or '').encode()) % 4}", len(WORD.findall(t or ""))) for i, t, lang, source, *_ in rows]
    leaves = defaultdict(int)
    for _, _, lang, source, domain, n in docs:
        leaves[domain, lang, source] += n
    granted = {(): sum(leaves.values()) if budget is None else budget}
    for depth, level in enumerate(("domain", "language", "origin"), 1):
        nxt = {}
        for parent, amount in granted.items():
            caps = defaultdict(int)
            for leaf, n in leaves.items():
                if leaf[: depth - 1] == parent:
                    caps[leaf[depth - 1]] += n * MAX_EPOCHS
            found = shared(amount, caps, lambda k: weights.get(level, {}).get(k, DEFAULT_WEIGHT))
            nxt |= {(*parent, k): v for k, v in found.items()}
        granted = nxt
    taken = defaultdict(int)
    for leaf, amount in granted.items():
        epochs, rest = divmod(amount, max(leaves[leaf], 1))
        mine = []
        for i, t, lang, source, domain, n in docs:
            if (domain, lang, source) == leaf:
                key = hashlib.md5(f"{SEED}:{epochs}:{'' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
                mine.append((key, i, n))
        upto = defaultdict(int)
        for key, _, n in mine:
            upto[key] += n
        running, total = {}, 0
        for key in sorted(upto):
            total += upto[key]
            running[key] = total
        for key, i, _ in mine:
            taken[i] += epochs + (running[key] <= rest)
    return {k: v for k, v in taken.items() if v}


def times(df):
    return {r.doc_id: r["count"] for r in df.groupBy("doc_id").count().collect()}


def test_against_brute_force(odd, scratch, spark):
    assert times(mix(odd, scratch)) == brute(odd_rows())
    assert times(mix(odd, type(scratch)(spark), budget=F.lit(700))) == brute(odd_rows(), 700)
    more = F.col("total") * 3
    total = sum(len(WORD.findall(t or "")) for _, t, *_ in odd_rows())
    assert times(mix(odd, type(scratch)(spark), budget=more)) == brute(odd_rows(), 3 * total)


def test_every_level_shares_by_weight(spark, scratch):
    rows = [(i, "w " * 50, ["en", "de"][i % 2], f"src{i % 4}", 1) for i in range(400)]
    weights = {"domain": {}, "language": {"en": 30, "de": 10}, "origin": {}}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = mix(docs, scratch, budget=F.lit(8000), domain=F.lit("one"), weights=weights)
    per = {r.language: r.n for r in got.groupBy("language").agg(F.sum("tokens").alias("n")).collect()}
    assert 5900 <= per["en"] <= 6000 and 1900 <= per["de"] <= 2000


def test_seeded(odd, scratch, spark):
    runs = [times(mix(odd.repartition(n), type(scratch)(spark), seed=s)) for n, s in ((1, 1), (5, 1), (1, 2))]
    assert runs[0] == runs[1] and runs[0] != runs[2]


def test_nothing_is_taken(odd, nothing, scratch, spark):
    assert mix(nothing, scratch).count() == 0
    assert mix(odd.where(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) > 0), type(scratch)(spark), budget=F.lit(0)).count() == 0


def test_clashing_names(clashing, scratch, odd, spark):
    got = mix(clashing, scratch, carry=clashing.columns)
    assert times(got) == times(mix(odd, type(scratch)(spark))) and got.where("fp = 'own'").count() == got.count()
