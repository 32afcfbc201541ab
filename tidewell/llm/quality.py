"""Quality rules by distribution divergence.

One pass over the texts takes, for each document, the base counts, a histogram
of character classes and a histogram of common words.  The reference of a
language is the sum of those histograms over all its documents that pass the
base rules and of whose words at least one in ANCHOR is on the fixed list of
the language, so that a corpus of mostly junk does not set its own reference;
languages without a list of common words share one reference, of character
classes only: its words are nearly all "no common word", as are those
of junk.  A document of a listed language is held against the nearest reference
of the listed languages by the Jensen-Shannon distance, base 2 (0 the same, 1
disjoint), so a mix of two of them or the label of another does not reject it.
One of any other language is held against all character classes and has no
distance of words.  Each distance counts only from a minimum length on, and
the limit for common words widens with the noise of a short text's histogram,
1 / sqrt(n_words).

Defined results: null and empty texts have no words and fail the base rules;
a null ``lang`` counts as another language; repeated rows are judged alike; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

MIN_WORDS = 50  # base rule
CLASS_MIN_CHARS = 200
WORD_MIN_WORDS = 100
ANCHOR = 10
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.24
WORD_NOISE = 1.5

# Common words of each language that has a reference of its own.
COMMON = {
    "en": """the of and to in a is that it for as was with be by on not he his but at are this have from or had an
        they which one you were all her she there would their we him been has when who will no more if out so""",
    "de": """der die das und ist von den dem ein eine zu nicht mit auf für sich des auch als an werden aus er hat
        dass sie nach wird bei noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr""",
    "fr": """le la les de des et à un une est que qui dans en du pour pas par sur au plus ce il se ne avec ou son
        je sont mais comme nous vous être cette ont leur elle aux""",
    "es": """el la los las de del y que en un una es se por con su para al lo como más no o pero sus le ha me si
        sin sobre este ya entre cuando todo esta ser son""",
}
_WORDS = {w.encode(): i for i, w in enumerate(dict.fromkeys(" ".join(COMMON.values()).split()))}
N_WORDS = len(_WORDS) + 1  # and all others
_OWN = {lang: [_WORDS[w.encode()] for w in words.split()] for lang, words in COMMON.items()}

# Character classes, told by bytes; a character beyond ASCII counts by its first byte.
_CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\x0b\x0c\r",
    b".,;:'\"-()?", b"!", b"#*$%&|<>", bytes(range(0xC2, 0xF5)),
)
N_CLASSES = len(_CLASSES) + 1
_CLASS = np.zeros((256, N_CLASSES), np.int64)
for _i, _set in enumerate(_CLASSES):
    _CLASS[list(_set), _i] = 1
_CLASS[[b for b in range(128) if not _CLASS[b].any()], -1] = 1
_BLANK, _SYMBOL, _TAIL = list(b" \t\n\x0b\x0c\r"), list(b"#*$%&|<>"), slice(0x80, 0xC0)

FEATURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("classes", "common")]
)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of `size` that the text holds twice or more."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + size - max(i, end)
            end = i + size
    return covered


def features(text: bytes) -> dict:
    words = text.split()  # of bytes: on the six ASCII blanks
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    common = np.zeros(N_WORDS, np.int64)
    for w, n in Counter(map(_WORDS.get, text.lower().split())).items():
        common[-1 if w is None else w] = n
    return {
        "n_words": len(words),
        "word_chars": int(seen.sum() - seen[_TAIL].sum() - seen[_BLANK].sum()),
        "n_symbols": int(seen[_SYMBOL].sum()),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "classes": seen @ _CLASS,
        "common": common,
    }


@F.arrow_udf(FEATURES)
def text_features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([(f.name, pa.int64() if f.dataType == T.LongType() else pa.list_(pa.int64())) for f in FEATURES])
    for batch in texts:
        yield pa.array((features(x.as_py()) for x in batch), kind, size=len(batch))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, of histograms; NaN where one is empty."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = (x / x.sum(axis=1, keepdims=True) for x in (p, q))
        m = (p + q) / 2
        d = sum(np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1) for x in (p, q)) / 2
        return np.sqrt(np.clip(np.where(np.isfinite(p.sum(axis=1) + q.sum(axis=1)), d, np.nan), 0, 1))


DISTANCES = T.StructType([T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType())])


def nearest(references: dict[str, list[int]]):
    """The distances of a row to the nearest reference of its kind; null if there is none."""
    listed = [np.array(references[k], float)[None, :] for k in sorted(references) if k in COMMON]
    others = [np.array(references[k], float)[None, :] for k in sorted(references) if k not in COMMON]

    @F.arrow_udf(DISTANCES)
    def distances(lang: pa.Array, classes: pa.Array, common: pa.Array) -> pa.Array:
        def least(column: pa.Array, refs: list[np.ndarray]) -> np.ndarray:
            own = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
            return np.fmin.reduce([np.full(len(own), np.nan)] + [js_distance(own, np.broadcast_to(r, own.shape)) for r in refs])

        other = ~np.isin(lang.to_numpy(zero_copy_only=False).astype(str), list(COMMON))
        by_class = least(classes, [r[:, :N_CLASSES] for r in listed])
        by_class = np.where(other, np.fmin(by_class, least(classes, [r[:, :N_CLASSES] for r in others])), by_class)
        by_word = np.where(other, np.nan, least(common, [r[:, N_CLASSES:] for r in listed]))
        return pa.StructArray.from_arrays([pa.array(x, pa.float64(), from_pandas=True) for x in (by_class, by_word)], DISTANCES.names)

    return distances


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The histograms of each language in a batch, added up over the documents that are told to be of it."""
    for batch in batches:
        lang = batch.column("lang").to_numpy(zero_copy_only=False).astype(str)
        hist = np.hstack([batch.column(n).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for n in ("classes", "common")])
        words, told = hist[:, N_CLASSES:], np.ones(len(lang), bool)
        for name, own in _OWN.items():
            mine = lang == name
            told[mine] = ANCHOR * words[np.ix_(mine, own)].sum(axis=1) >= words[mine].sum(axis=1)
        langs, at = np.unique(lang[told], return_inverse=True)
        hist = hist[told]
        total = np.zeros((len(langs), hist.shape[1]), np.int64)
        np.add.at(total, at, hist)
        kind = pa.schema([("lang", pa.string()), ("hist", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_pydict({"lang": langs.tolist(), "hist": total.tolist()}, kind)


def quality(docs: DataFrame, scratch: Scratch, carry: Iterable[str] = ("doc_id",), max_class: float = MAX_CLASS_DISTANCE,
            max_word: float = MAX_WORD_DISTANCE, word_noise: float = WORD_NOISE) -> DataFrame:
    """Every row (its carried columns) with the base counts, base_failed, class_distance, word_distance, kept."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    carry = [c for c in carry if c not in (*counts, "base_failed", "class_distance", "word_distance", "kept")]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    lang = F.when(F.col("lang").isin(list(COMMON)), F.col("lang")).otherwise("other").alias("lang")
    rows = docs.select(F.struct(F.lit(0).alias("_"), *carry).alias("row"), lang, text_features(text).alias("f"))
    rows = scratch.cut(rows.select("row", "lang", "f.*"), "features")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", base_failed)

    sums = rows.where(~F.col("base_failed")).select("lang", "classes", "common")
    sums = sums.mapInArrow(_sums, "lang string, hist array<bigint>").select("lang", F.posexplode("hist").alias("at", "n"))
    sums = sums.groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()  # a number for each bin of five references
    references: dict[str, list[int]] = {}
    for name, at, n in sums:
        references.setdefault(name, [0] * (N_CLASSES + N_WORDS))[at] = n

    rows = rows.withColumn("d", nearest(references)("lang", "classes", "common")).select("*", "d.*")
    too_far = (F.col("class_distance") > max_class) & (F.col("word_chars") >= CLASS_MIN_CHARS)
    limit = max_word + word_noise / F.sqrt(F.col("n_words"))
    too_far |= (F.col("word_distance") > limit) & (F.col("n_words") >= WORD_MIN_WORDS)
    return rows.select(
        *[F.col("row")[c].alias(c) for c in carry], *counts, "base_failed", "class_distance", "word_distance",
        (~F.col("base_failed") & ~F.coalesce(too_far, F.lit(False))).alias("kept"),
    )
