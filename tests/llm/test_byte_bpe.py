"""Byte-level BPE against the other library of the same ranks, and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidewell.llm import byte_bpe as bpe

PATH = public_tokenizers.path(bpe.RANKS)
CODE_POINTS = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def odd_texts():
    rng = random.Random(1)
    mixed = [*range(32, 127), 9, 10, 0x85, 0xA0, 0x3000, 0x2028, 0xE9, 0xC5D0, *[0x20] * 30]
    found = ["", " ", "   ", "a", "x" * 200_000, " " * 5_000 + "a", "a  b\n\n \tc'S't's <|endoftext|> <|fim|>\x00\x1c é" * 50, "한국어 텍스트 " * 30, "\n", "é é  é", "　a　 b"]
    for _ in range(300):
        found.append("".join(chr(rng.choice(mixed) if rng.random() < 0.8 else rng.choice([rng.randrange(0x80, 0xD800), rng.randrange(0x10000, 0x110000)])) for _ in range(rng.randint(1, 300))))
    return found


def test_every_code_point_is_split_as_the_other_library_splits_it(reference):
    for text in (CODE_POINTS, " ".join(CODE_POINTS[:70_000]), "1".join(CODE_POINTS[-60_000:])):
        assert bpe.encode_texts(pa.array([text]), bpe.Memo(PATH)).to_pylist() == [reference.encode_ordinary(text)]


def test_odd_texts(reference):
    texts, memo = odd_texts(), bpe.Memo(PATH)
    got = [ids for g in bpe.groups(pa.array([*texts, None]), 1000) for ids in bpe.encode_texts(g, memo).to_pylist()]
    assert got == [reference.encode_ordinary(t) for t in texts] + [[]]


def test_a_memo_that_forgets(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    texts, memo = odd_texts()[5:60], bpe.Memo(PATH)
    assert [bpe.encode_texts(pa.array([t]), memo).to_pylist()[0] for t in texts * 2] == [reference.encode_ordinary(t) for t in texts * 2]


def test_slices_of_arrays(reference):
    texts = pa.array(["no", "one two", None, "", "three  four", "no"]).slice(1, 4)
    assert bpe.encode_texts(texts, bpe.Memo(PATH)).to_pylist() == [reference.encode_ordinary(t) for t in ("one two", "", "", "three  four")]


def test_parts_are_cut_between_matches(reference):
    rng = random.Random(2)
    for text in odd_texts():
        parts = list(bpe.parts(text, rng.randint(1, 40)))
        assert "".join(p for _, p in parts) == text and all(text.startswith(p, i) for i, p in parts)
        assert [x for _, p in parts for x in reference.encode_ordinary(p)] == reference.encode_ordinary(text)


def test_offsets(monkeypatch, reference):
    monkeypatch.setattr(bpe, "GROUP", 50)
    for text in odd_texts()[:120]:
        ids, spans = bpe.offsets_of(text, PATH)
        assert ids.tolist() == reference.encode_ordinary(text)
        for token, (begin, end) in zip(bpe.token_bytes(PATH).take(pa.array(ids)).to_pylist(), spans, strict=True):
            assert token in text[begin:end].encode() and end - begin <= len(token)
        assert all(a <= b for a, b in zip(spans[:-1, 1], spans[1:, 1], strict=True))


def test_byte_table():
    shown = bpe.byte_characters()
    assert len(set(shown)) == 256 and all(c.isprintable() and not c.isspace() for c in shown) and shown[0x20] == "Ġ" and shown[0x41] == "A"
    assert all(bpe.as_bytes(bpe.as_characters(t)) == t for t in list(bpe.read_ranks(PATH))[:5000])


def test_split_characters_belong_to_the_token_that_completes_them():
    assert bpe.texts_of([b"a\xed", b"\x95", b"\x9cb", b"c"]) == ["a", "", "한b", "c"]
    assert bpe.texts_of([b"\xff", b"x\xed"]) == ["�", "x�"] and bpe.texts_of([]) == []


def test_columns(spark, odd, clashing, nothing, reference):
    rows = clashing.select("*", bpe.encode(F.col("text")).alias("ids"), bpe.encode_with_offsets(F.col("text")).alias("t"))
    rows = rows.select("doc_id", "text", "ids", "t", bpe.decode(F.col("ids")).alias("bytes"), bpe.packed(F.col("ids")).alias("packed"), bpe.decode_tokens(F.col("ids")).alias("pieces")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = r.text or ""
        assert r.ids == reference.encode_ordinary(text) == r.t.ids and bytes(r.bytes) == text.encode() and "".join(r.pieces) == text
        assert bytes(r.packed) == np.array(r.ids, "<u4").tobytes() and len(r.t.begins) == len(r.t.ends) == len(r.ids)
    assert nothing.select(bpe.decode(bpe.encode(F.col("text")))).isEmpty()


def test_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(None,), ([],), ([15496, 11],)], "ids array<int>").coalesce(1)
    got = rows.select(bpe.decode(F.col("ids")).alias("b"), bpe.decode_tokens(F.col("ids")).alias("t"), bpe.packed(F.col("ids")).alias("p")).collect()
    assert [(r.b, r.t, r.p) for r in got] == [(None, None, None), (b"", [], b""), (b"Hello,", ["Hello", ","], b"\x88<\x00\x00\x0b\x00\x00\x00")]
    with pytest.raises(Exception, match="bounds"):
        spark.createDataFrame([([60_000],)], "ids array<int>").select(bpe.decode(F.col("ids"))).collect()


def test_query_over_a_whole_table(spark, reference):
    from tidewell.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
