"""Documents with every oddity: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

import pytest

from tidewell.llm.scratch import Scratch

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = (
    "row string, id string, fp string, rid string, fingerprint string, component_id string, first string, keep_id string, group_size string, "
    "kept string, text_sha256 string, length string, digit string, gid string, n string, domain string, language string, origin string, "
    "tokens string, epoch string, bytes string, shard string, hash string, part string, piece string, start string, ids_crc32 string, "
    "sequence_id string, offset string, rank string, score string, held_out string, predicted string, n_words string, word_chars string, "
    "f string, d string, classes string, base_failed string"
)


@pytest.fixture
def scratch(spark):
    return Scratch(spark)


def prose(rng: random.Random, n: int) -> str:
    words = "the of and to a in that stone river is was house light for with morning quiet not letters he road walked under".split()
    return " ".join(rng.choice(words) for _ in range(n))


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    long_text = prose(rng, 30_000)
    some = prose(rng, 120)
    rows = [
        (1, some, "en", "src0", 10), (2, some, "en", "src0", 10), (2, some, "en", "src0", 10), (3, some.upper(), "en", "src1", None),
        (4, None, "en", "src0", 0), (5, "", "de", "src2", 0), (6, " \n\t ", None, None, 3), (None, "no id", "xx", "src1", 5),
        (7, long_text, "en", "src0", 1), (8, long_text + " end", "en", "src1", 1), (9, "x" * 50_000, "en", "src0", 1),
        (10, "İstanbul ÄÖ ß Ñ 한국어 \U0001f600 emoji", "de", "src3", 1), (11, "</s> <|endoftext|> [INST]", "fr", "src4", 1), (None, None, None, None, None),
    ]
    return rows + [(100 + i, prose(rng, rng.randint(1, 90)), rng.choice(["en", "de", "fr", "es", "it"]), f"src{i % 5}", 1) for i in range(30)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCUMENT).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """odd with extra columns that are named like the operators' own."""
    names = [x.split()[0] for x in CLASHING.split(", ")]
    return odd.selectExpr("*", *[f"'own' AS `{n}`" for n in names])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENT)
