import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewell.llm.quality import js_distance, quality

from .conftest import odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    times = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    base = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
    return (*base, len(words) < 50 or 100 * len(inside) > 50 * len(words))


ROWS = [
    (1000, "a b c " * 40, "en", "s", 1), (1001, "one two three\n" * 3 + "\n\none two three\n * # $ %", "en", "s", 1),
    (1002, "a a a a", "en", "s", 1), (1003, "x\x0by\x0cz\rq \x1c\x85\xa0 w", "en", "s", 1), (1004, "|<>&$#*% \n \n \n", "en", "s", 1),
]


def test_base_counts(spark, odd, scratch):
    rows = odd_rows() + ROWS
    got = quality(odd.unionAll(spark.createDataFrame(ROWS, odd.schema)), scratch).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, text, *_ in rows:
        if i is not None:
            r = by_id[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), i
            assert not (r.base_failed and r.kept)


def test_divergence_rejects_other_distributions(spark, scratch):
    import random

    from .conftest import prose

    rng = random.Random(3)
    good = [(i, prose(rng, 300), "en", "s", 1) for i in range(60)]
    symbols = " ".join("".join(rng.choices("#$%&{}[]=;0123456789", k=6)) for _ in range(300))
    shuffled = " ".join("".join(rng.choices("bcdfgklmprstaeiou", k=rng.randint(3, 8))) for _ in range(300))
    short = " ".join(shuffled.split()[:55])  # below the least number of words for the word histogram
    docs = spark.createDataFrame([*good, (100, symbols, "en", "s", 1), (101, shuffled, "en", "s", 1), (102, short, "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id: r.kept for r in quality(docs, scratch).collect()}
    assert all(kept[i] for i in range(60))
    assert not kept[100] and not kept[101] and kept[102]


POLISH = """Nad rzeką stał stary młyn, w którym od wielu lat nikt już nie mieszkał. Dzieci ze wsi opowiadały sobie, że nocą słychać
tam kroki młynarza, lecz dorośli śmiali się z tych historii. Pewnego jesiennego wieczoru młody nauczyciel postanowił sprawdzić, ile jest
w nich prawdy. Wziął latarnię, ciepły płaszcz oraz kawałek chleba i ruszył ścieżką przez mokre łąki. Kiedy otworzył drzwi, zobaczył
tylko kurz, połamane koło i gniazdo sowy pod belką. Usiadł przy oknie, żeby poczekać do północy, a deszcz cicho bębnił o dach.
Wtedy usłyszał kroki, które zbliżały się powoli od strony schodów. Okazało się, że to sąsiad szukał swojego zagubionego psa.
Obaj roześmiali się głośno, podzielili chleb i wrócili razem do domu, zanim wzeszło słońce nad doliną."""


def test_an_unlisted_language_hides_no_junk(spark, scratch):
    import random

    from .conftest import prose

    rng = random.Random(3)
    rows = [(i, prose(rng, 300), "en", "s", 1) for i in range(60)]
    rows += [(100, POLISH, "pl", "s", 1), (101, " ".join("".join(rng.choices("bcdfgklmprstaeiou", k=rng.randint(3, 8))) for _ in range(300)), "en", "s", 1)]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), scratch).collect()}
    assert all(got[i].kept for i in range(60))
    assert not got[101].kept
    assert got[100].kept and got[100].word_distance is None and got[100].class_distance is not None


def test_js_distance():
    p, q = np.array([[1, 0, 0], [1, 1, 0], [0, 0, 0]]), np.array([[0, 5, 0], [2, 2, 0], [1, 0, 0]])
    d = js_distance(p, q)
    assert d[0] == pytest.approx(1) and d[1] == pytest.approx(0) and np.isnan(d[2])


def test_empty(nothing, scratch):
    assert quality(nothing, scratch).count() == 0


def test_nothing_passes_the_base_rules(spark, nothing, scratch):
    docs = spark.createDataFrame([(1, "too short", "en", "s", 1), (2, None, None, None, None)], nothing.schema)
    assert [r.kept for r in quality(docs, scratch).collect()] == [False, False]


def test_clashing_names(clashing, scratch):
    got = quality(clashing, scratch, carry=clashing.columns)
    assert got.count() == len(odd_rows()) and got.where("shard = 'own'").count() == len(odd_rows())


def test_a_corpus_of_mostly_junk_does_not_set_its_own_reference(spark, scratch):
    rng = random.Random(8)
    junk = [" ".join("".join(rng.choices("zxqjkvwy", k=rng.randint(3, 9))) for _ in range(150)) for _ in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(junk)] + [(100 + i, prose(rng, 200), "en") for i in range(6)]
    got = quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), scratch)
    assert {r.doc_id for r in got.where("kept").collect()} == set(range(100, 106))
