import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm.packing import CAPACITY, END, Reduction, best_fit, pack, places, plan, tokenizer

from .conftest import odd_rows


@pytest.fixture(scope="module")
def reference():
    found = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return lambda text: found.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(reference):
    own = tokenizer(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    rng = random.Random(4)
    alphabet = ["a", "B", "'s", "'LL", " ", "  ", "\n", "\t", "1", "23", ".", "...", "é", "ß", "한", " ", " ", "​", "\U0001f600", "word", "<|endoftext|>", "<|", "|>", "\r", "\x1c", "\x85", "٣", "²", "_"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(5000)] + [" " * 300_000, "a" * 300_000] + [t or "" for _, t, *_ in odd_rows()]
    for text in texts:
        assert own(text).tolist() == reference(text), repr(text)


def check(rows, got, reference, capacity):
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, text, *_ in rows:
        ids = [*reference(text or ""), END]
        mine = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert 0 < r.length <= capacity and (r.piece == 0 or r.length == capacity)
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packed_whole(spark, odd, scratch, reference):
    rows = [(i, t) for i, (_, t, *_) in enumerate(odd_rows())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for capacity in (CAPACITY, 64):
        got = pack(docs, type(scratch)(spark), capacity=capacity).collect()
        n = check(rows, got, reference, capacity)
        assert n >= sum(r.length for r in got) / capacity


def test_ids_with_the_pieces(spark, scratch):
    docs = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pack(docs, scratch, with_ids=True).collect()}
    assert got[2].ids == [END] and got[1].ids[-1] == END and len(got[1].ids) == got[1].length


def placed(patterns):
    found = Counter()
    for pattern, times in patterns.items():
        for size in pattern:
            found[size] += times
    return found


def fewest(sizes: list[int], capacity: int) -> int:
    """The least number of bins, by search."""
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in {r: j for j, r in enumerate(bins)}.values():
            if bins[b] >= sizes[i]:
                bins[b] -= sizes[i]
                go(i + 1, bins)
                bins[b] += sizes[i]
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_loses_no_optimum(sizes):
    reduction = Reduction(dict(Counter(sizes)), 20)
    fixed = reduction.reduce()
    rest = [s for s, n in reduction.left.items() for _ in range(n)]
    assert placed(fixed) + Counter(rest) == Counter(sizes)
    assert all(sum(p) <= 20 for p in fixed)
    assert sum(fixed.values()) + (fewest(rest, 20) if rest else 0) == fewest(sizes, 20)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=20))
def test_plan_places_everything_once(counts):
    patterns = plan(counts, 64)
    assert placed(patterns) == Counter(counts) and all(sum(p) <= 64 for p in patterns)
    for size, rows in places(patterns).items():
        assert [r[0] for r in rows] == sorted({r[0] for r in rows}), size


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_best_fit_is_the_plain_one(sizes):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fitting = [r for r in rooms if r >= s]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - s)
        else:
            rooms.append(64 - s)
    assert sum(best_fit(dict(Counter(sizes)), 64).values()) == len(rooms)


def test_empty(nothing, scratch):
    assert pack(nothing, scratch).count() == 0


def test_clashing_names(clashing, scratch):
    got = pack(clashing, scratch, carry=clashing.columns)
    assert got.where("piece = 0").count() == len(odd_rows()) and got.where("origin = 'own'").count() == got.count()
