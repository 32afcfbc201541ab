import random

import numpy as np
import pytest

from tidewell.llm.toxicity import _Decisions, ORDER, SPAN, DECAY, letters, score_toxicity, subsequences, tokens_of, train, windows_of

from .conftest import odd_rows, prose

INSULTS = ["zorglub", "krampfnik", "blattorn", "murkelwit"]


def gapped(rng, word):
    at = rng.randint(1, len(word) - 1)
    return rng.choice([word[:at] + rng.choice("-.*_") + word[at:], word[:at] + rng.choice("xqz") + word[at:], " ".join(word), word.upper(), word.replace("o", "0")])


def corpus(rng, n):
    rows = []
    for i in range(n):
        words, toxic = prose(rng, rng.randint(5, 60)).split(), int(rng.random() < 0.3)
        if toxic:
            word = rng.choice(INSULTS)
            words.insert(rng.randint(0, len(words)), gapped(rng, word) if rng.random() < 0.3 else word)
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = corpus(random.Random(8), 900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").cache()
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id bigint, quality int, toxic int").cache()
    return rows, docs, labels, train(docs, labels)


def test_held_out_accuracy(spark, fitted):
    rows, docs, _, model = fitted
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    held = [(toxic, got[i].predicted) for i, _, toxic in rows if got[i].held_out]
    assert len(held) > 100
    assert np.mean([a == b for a, b in held]) > 0.95


def test_gapped_and_inserted_insults(spark, fitted):
    rng = random.Random(9)
    rows = [(i, f"{prose(rng, 200)} {gapped(rng, rng.choice(INSULTS))} {prose(rng, 200)}") for i in range(100)]
    rows += [(1000 + i, prose(rng, 400)) for i in range(100)]
    got = {r.doc_id: r.predicted for r in score_toxicity(spark.createDataFrame(rows, "doc_id bigint, text string"), fitted[3]).collect()}
    assert np.mean([got[i] for i in range(100)]) > 0.9 and sum(got[1000 + i] for i in range(100)) == 0


def test_held_out_labels_are_not_read(spark, fitted):
    _, docs, labels, model = fitted
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    other = train(docs, turned)
    assert model[1:] == other[1:] and model[0] == other[0]


def test_labels_are_no_input_of_a_score(spark, fitted):
    got = score_toxicity(spark.createDataFrame([(1, "a zorglub"), (99, "a zorglub"), (None, "a zorglub")], "doc_id bigint, text string"), fitted[3]).collect()
    assert len({r.score for r in got}) == 1


def test_subsequence_kernel():
    def brute(word):
        from itertools import combinations

        found = {}
        for where in combinations(range(len(word)), ORDER):
            span = where[-1] - where[0] + 1
            if span <= SPAN:
                key = tuple(word[i] for i in where)
                found[key] = found.get(key, 0) + DECAY**span
        norm = sum(v * v for v in found.values()) ** 0.5
        return {k: v / norm for k, v in found.items()}

    for word in ("abcd", "abcabc", "zorglub", "aaaaaaa"):
        assert subsequences(word) == pytest.approx(brute(word))
    assert subsequences("abc") == {}


def test_words():
    assert letters('"h3llo!"') == "hello" and letters("2024") == "" and letters("a-b.c") == "abc"
    assert "idiot" in tokens_of("you I D I O T there")
    long_word = "x" * 20 + "needle" + "y" * 20
    assert any("needle" in w for w in windows_of(long_word)) and windows_of("short") == ["short"]


def test_odd_rows(odd, fitted):
    got = score_toxicity(odd, fitted[3]).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_without_labels(odd, spark):
    labels = spark.createDataFrame([(1, 1, None), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert train(odd, labels) is None
    assert {r.score for r in score_toxicity(odd, None).collect()} == {0.0}


def test_empty(nothing, fitted):
    assert score_toxicity(nothing, fitted[3]).count() == 0


def test_clashing_names(clashing, fitted):
    got = score_toxicity(clashing, fitted[3], carry=clashing.columns)
    assert got.count() == len(odd_rows()) and got.where("shard = 'own'").count() == len(odd_rows())


def test_repeated_ids_are_trained_on_once(spark, fitted):
    _, docs, labels, model = fitted
    ids = docs.select("doc_id")
    twice = train(docs.unionAll(docs).unionAll(ids.selectExpr("doc_id", "'~ later text' AS text").where("doc_id < 0")), labels.unionAll(labels))
    assert twice[1:] == model[1:] and twice[0] == model[0]


def test_decisions_of_many_words_are_those_of_the_kernel():
    rng = random.Random(3)
    weights = {k: rng.gauss(0, 1) for w in ("zorglub", "idiöt", "ñandú", "abcabcabc") for k in subsequences(w)}
    words = ["zorglub", "aaaaaaa", "thththth", "\U0001f600abcd", "idiöt"] + ["".join(rng.choices("abcdefgiklorzuö", k=rng.randint(4, 14))) for _ in range(500)]
    got = _Decisions(weights, -0.5).of_words(words)
    for w in words:
        assert got[w] == pytest.approx(-0.5 + sum(v * weights.get(k, 0.0) for k, v in subsequences(w).items())), w
