import hashlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewell.llm.exact_dedup import exact_dedup
from tidewell.llm.scratch import Scratch

from .conftest import odd_rows

LOWER = {i: i + 32 for i in range(65, 91)}


def check(rows, got):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[(text or "").translate(LOWER)].append(i)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.doc_id in ids and r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)


def test_odd_rows(odd, scratch):
    check(odd_rows(), exact_dedup(odd, scratch).collect())


def test_texts_that_part_late(spark, scratch):
    base = "ab cd é " * 5000
    rows = [(i, base + tail) for i, tail in enumerate(["", "", "x", "X", "y", "é", "É"])] + [(20, base[:-1]), (21, base[:60]), (22, base[:60])]
    rows += [(30 + i, base[:17_500] + c + base[17_501:]) for i, c in enumerate("qQr")]
    check(rows, exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), scratch).collect())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("aAbBéÉ \n\0"), max_size=70), min_size=1, max_size=25))
def test_any_texts(spark, texts):
    rows = list(enumerate(texts + texts[:3]))
    check(rows, exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), Scratch(spark)).collect())


def test_empty(nothing, scratch):
    assert exact_dedup(nothing, scratch).count() == 0


def test_clashing_names(clashing, scratch):
    got = exact_dedup(clashing, scratch, carry=clashing.columns)
    rows = got.select("doc_id", "text", "keep_id", "group_size", "kept", "text_sha256", "origin").collect()
    check(odd_rows(), rows)
    assert {r.origin for r in rows} == {"own"}
    assert all(hashlib.sha256((r.text or "").translate(LOWER).encode()).hexdigest() == r.text_sha256 for r in rows)
