import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
import tidewell.llm.near_copies as module
from tidewell.llm.near_copies import near_copies, shingle_set
from tidewell.llm.simhash_dedup import RADIUS, majority

from .conftest import odd_rows

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words_of(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, least=(4, 5)):
    """The smallest id of each row's component, from all pairs."""
    sets, root = [words_of(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if least[1] * len(sets[i] & sets[j]) >= least[0] * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    lowest = {}
    for i, (key, _) in enumerate(rows):
        lowest[top(i)] = min(key, lowest.get(top(i), key))
    return {key: lowest[top(i)] for i, (key, _) in enumerate(rows)}


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def some():
    rng = random.Random(21)
    made = []
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 200))]
        made.append(" ".join(base))
        made += [edited(rng, base, rng.randint(1, max(1, len(base) // 30))) for _ in range(rng.randint(0, 5))]
    passage = " ".join(f"p{i}" for i in range(40))
    made += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(5, 60))) for _ in range(300)]
    made += ["", "a", "A", " a ", "one two three", "x y z x y z x y z"]
    rng.shuffle(made)
    return list(enumerate(made))


def test_equals_all_pairs(spark, scratch, some):
    docs = spark.createDataFrame(some, "doc_id bigint, text string").repartition(3)
    got = near_copies(docs, scratch).collect()
    want = brute(some)
    assert 1 < len(set(want.values())) < len(want)
    assert {r.doc_id: r.component_id for r in got} == want
    assert sorted(r.doc_id for r in got if r.first) == sorted(set(want.values()))


def test_stage_drops_copies_far_apart_in_bits(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(1, " ".join(base), "en", "s", 1)]
    rows += [(2 + i, edited(rng, base, 4), "en", "s", 1) for i in range(8)]  # 0.81 or more to the first
    docs = spark.createDataFrame(rows, DOCUMENT)
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()] == [1]


def bits_of(text):
    return majority(shingle_set(text.encode()).view(np.uint64)) & (2**64 - 1)


def test_stage_goes_by_fingerprints(spark, monkeypatch):
    """Without prefixes it links what op1's tables find, if the texts are similar."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base)] + [edited(rng, base, 1) for _ in range(12)] + [" ".join(f"x{rng.randrange(10**6)}" for _ in range(100)) for _ in range(5)]
    near = [(bits_of(t) ^ bits_of(texts[0])).bit_count() for t in texts]
    assert sum(0 < n <= RADIUS for n in near) > 5
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCUMENT)
    monkeypatch.setattr(module, "prefix", lambda found, common, least: found[:0])
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert 0 in left and left >= set(range(13, 18)) and not left & {i for i, n in enumerate(near) if i and n <= RADIUS}


def test_close_fingerprints_of_other_texts_are_no_copies(spark, scratch, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(module, "majority", lambda hashes: 5)  # all texts agree in all bits
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]
    got = near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), scratch).collect()
    assert len(got) == 20 and all(r.first for r in got)


def test_each_fingerprint_names_its_nearest(spark, scratch):
    base = 0x0123456789ABCDEF
    words = [base, base, base ^ 1, base ^ 0b11110, base ^ 0xFFFF00, base ^ (0xFF << 40)]
    pairs = module.close_fingerprints(spark.createDataFrame(list(enumerate(words)), "node bigint, fp bigint"), scratch).collect()
    found = {(r.a, r.b) for r in pairs}
    assert (0, 1) in found and len(pairs) == 3 and all(a < b < 4 for a, b in found)


def test_odd_rows(spark, odd, nothing, scratch):
    got = near_copies(odd, scratch).collect()
    assert len(got) == len(odd_rows())
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[7] == by_id[8] == 7 and by_id[4] == by_id[5] == by_id[6] == 4


def test_empty(nothing, scratch):
    assert near_copies(nothing, scratch).count() == 0


def test_clashing_names(clashing, scratch):
    got = near_copies(clashing, scratch, carry=clashing.columns)
    assert got.count() == len(odd_rows()) and got.where("fp = 'own' AND shard = 'own'").count() == len(odd_rows())
