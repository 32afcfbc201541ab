"""Phrase collocations by hashed buckets (PCY, DHP) and Apriori pruning.

Phrases of n words are counted in pass n.  Each pass but the last also counts
the phrases of n + 1 words by the bucket that their hash falls into; buckets
under the least count cannot hold a frequent phrase.  A pass counts exactly
only those phrases whose bucket reached the least count and whose parts of
n - 1 words are frequent themselves.  Both facts reach the tasks as bitmaps of
2**bits bits, however large the corpus: a set bit may be wrong (two phrases
share it), which costs a count and no more; a clear bit never is.  What is kept
is decided by exact counts of whole phrases.  The number of buckets follows the
size of the texts, as buckets that many rare phrases share prune nothing.

Each task reads its texts as byte buffers of one language, finds the words by
array operations and counts phrases as Arrow values; what it holds is bounded
by FLUSH rows and the buckets of PACK phrases.  Bucket counts are handed on
packed, one row for each range of buckets, and added up as arrays, range by
range; Spark adds up the phrases.

Defined results: a null text is empty, a null language is ``und``; repeated rows
count each; an empty table gives no phrases; texts and words of any length are
read whole, in buffers that carry the last words over; rows are never dropped.
Ties of the score go by count and then by the phrase's bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

LEAST = 10  # occurrences of a phrase
LONGEST = 3  # words of a phrase
COVERED = 50  # per cent of a phrase's occurrences inside a longer one that drop it
TOP = 2000  # phrases of a language
BITS = 24  # fewest buckets, as a power of two: 2 MB a bitmap
MOST_BITS = 28  # and the most: 32 MB
BUCKET = 32  # bytes of text for each bucket, between these two
RANGE = 18  # buckets that one row of packed counts covers, as a power of two
PACK = 1 << 22  # phrases that a task holds before it hands on their bucket counts
BUFFER = 1 << 18
FLUSH = 200_000  # phrases that a task holds before it hands them on
BLANKS, ENDS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"  # between words, between pieces
PARTS = "lang string, phrase string, bucket bigint, n bigint"
PACKED = "lang string, phrase string, n bigint, range bigint, counts binary"

_KIND = np.zeros(256, np.uint8)  # 0 part of a word, 1 blank, 2 end of a piece
_KIND[list(BLANKS)] = 1
_KIND[list(ENDS)] = 2
_BETWEEN = re.compile(b"[" + BLANKS + ENDS + b"]")
_WORD = re.compile(b"[^" + BLANKS + ENDS + b"]+")
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, x, np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors)
    return _powers[0][:n], _powers[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    for factor, shift in zip(_MIX, (30, 27), strict=True):
        h = (h ^ (h >> np.uint64(shift))) * factor
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a buffer, each followed by one blank in `text`: hashes, pieces, and phrases as Arrow values."""

    def __init__(self, lang: str, buffer: bytes):
        b = np.frombuffer(buffer.lower(), np.uint8)  # of bytes: A-Z alone
        kind = _KIND[b]
        inside = kind == 0
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, end = edges[::2], edges[1::2]
        self.n = len(first)
        keep = np.append(inside, False)
        keep[end] = True
        self.text = np.append(np.where(inside, b, 0x20), 0x20)[keep].astype(np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum(end - first + 1))).astype(np.int64)
        self.piece = np.cumsum(kind == 2)[first] if self.n else np.zeros(0, np.int64)
        power, inverse = _power(len(self.text) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * power[:-1])))
            own = (sums[self.offsets[1:]] - sums[self.offsets[:-1]]) * inverse[self.offsets[:-1]]
            self.hashes = [_mixed(own + np.uint64(zlib.crc32(lang.encode())))]

    def hash(self, n: int) -> np.ndarray:
        """Of the n words from each word on; at the end of the buffer fewer."""
        while len(self.hashes) < n:
            last, k = self.hashes[-1], len(self.hashes)
            with np.errstate(over="ignore"):
                self.hashes.append(_mixed(last[: max(0, self.n - k)] * _MIX[0] + self.hashes[0][k:]))
        return self.hashes[n - 1]

    def bucket(self, n: int, bits: int) -> np.ndarray:
        return (self.hash(n) >> np.uint64(64 - bits)).astype(np.int64)

    def whole(self, n: int, done: int = 0) -> np.ndarray:
        """Whether the n words from each word on are of one piece, and end after the `done` first words."""
        starts = max(0, self.n - n + 1)
        whole = self.piece[:starts] == self.piece[n - 1 :][:starts] if n > 1 else np.ones(starts, bool)
        whole[: max(0, done - n + 1)] = False
        return whole

    def counted(self, n: int, mask: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """The phrases of n words that begin where mask is set, with a blank at their end, and how often."""
        found = []
        for phase in range(n):  # those n words apart lie end to end
            at = self.offsets[phase::n]
            if len(at) > 1:
                values = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(self.text)])
                found.append(values.filter(pa.array(mask[phase::n][: len(at) - 1])))
        counts = pa.chunked_array(found, pa.large_binary()).value_counts() if found else pa.array([], pa.struct([("values", pa.large_binary()), ("counts", pa.int64())]))
        return counts.field("values"), counts.field("counts")


def buffers(texts: Iterable[bytes], carried: int, size: int = BUFFER) -> Iterator[tuple[bytes, int]]:
    """(buffer, words at its start that the buffer before has too): short texts end to end, long ones in parts."""
    held: list[bytes] = []
    length = 0
    for text in texts:
        if length + len(text) > size and held:
            yield b"\n".join(held), 0
            held, length = [], 0
        if len(text) > size:
            yield from _long(text, carried, size)
        else:
            held.append(text)
            length += len(text) + 1
    if held:
        yield b"\n".join(held), 0


def _long(text: bytes, carried: int, size: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a text, cut where a piece ends; if none does within `size`, behind a word, and the last `carried` words come again."""
    start = seen = done = 0
    while True:
        end = len(text)
        if end - start > size:
            new = _WORD.search(text, seen)  # at least a word that was not in the part before
            found = _BETWEEN.search(text, max(start + size, new.end())) if new else None
            end = found.start() if found else end
        piece = max(text.rfind(bytes([x]), start, end) for x in ENDS) if end < len(text) else -1
        if piece >= 0:
            end = piece + 1
        yield text[start:end], done
        if end == len(text):
            return
        if piece >= 0:
            start, done = end, 0
        else:  # no piece ends in here, so none ends among the words that come again
            words = [m.start() for m in _WORD.finditer(text, start, end)]
            done = min(carried, len(words))
            start = words[-done] if done else end
        seen = end


def _packing(bits: int, least: int) -> tuple[int, int, type]:
    """Bits of a bucket's place in its range, bits of a count up to `least`, and the type that holds both."""
    low, room = min(bits, RANGE), least.bit_length()
    return low, room, np.uint32 if low + room <= 32 else np.uint64


def _pack(buckets: np.ndarray, bits: int, least: int) -> Iterator[tuple[int, bytes]]:
    """(range, packed counts) of buckets, one for each time that they were met; counts over `least` are `least`."""
    low, room, kind = _packing(bits, least)
    buckets = np.sort(buckets)
    first = np.flatnonzero(np.diff(buckets, prepend=buckets[:1] + 1 if len(buckets) else []))
    at, times = buckets[first].astype(np.uint64), np.diff(first, append=len(buckets))
    packed = ((at & np.uint64((1 << low) - 1)) << np.uint64(room) | np.minimum(times, least).astype(np.uint64)).astype(kind)
    ranges = at >> np.uint64(low)
    edges = np.flatnonzero(np.diff(ranges, prepend=ranges[:1] + np.uint64(1), append=ranges[-1:] + np.uint64(1)))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        yield int(ranges[i]), packed[i:j].tobytes()


def _unpack(data: bytes, bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the range, count) of packed counts; each place comes once."""
    _, room, kind = _packing(bits, least)
    packed = np.frombuffer(data, kind).astype(np.uint64)
    return (packed >> np.uint64(room)).astype(np.int64), (packed & np.uint64((1 << room) - 1)).astype(np.int64)


def _counting(n: int, longest: int, bits: int, frequent: bytes | None, bucket: bytes | None, flush: int, least: int):
    """Pass n over batches of (lang, text): exact counts of phrases of n words, packed bucket counts of those of n + 1."""

    def passes(words: Words, k: int, bitmap: np.ndarray | None) -> np.ndarray:
        if bitmap is None:
            return np.ones(max(0, words.n - k + 1), bool)
        at = words.bucket(k, bits)
        return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot = (np.frombuffer(x, np.uint8) if x is not None else None for x in (frequent, bucket))
        met: list[np.ndarray] = []  # buckets, once for each phrase of n + 1 words
        held: list[pa.Table] = []
        rows = phrases_met = 0

        def handed(table: pa.Table) -> pa.RecordBatch:
            phrase = pc.binary_slice(table["phrase"].combine_chunks(), 0, -1).cast(pa.string())
            lang = table["lang"].combine_chunks().cast(pa.string())
            none = pa.nulls(len(phrase), pa.int64()), pa.nulls(len(phrase), pa.binary())
            return pa.RecordBatch.from_arrays([lang, phrase, table["n_sum"].combine_chunks(), *none], ["lang", "phrase", "n", "range", "counts"])

        def summed() -> pa.Table:
            table = pa.concat_tables(held)
            return table.group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])

        def packed() -> Iterator[pa.RecordBatch]:
            found = list(_pack(np.concatenate(met), bits, least))
            for i in range(0, len(found), 64):
                ranges, counts = zip(*found[i : i + 64], strict=True)
                none = pa.nulls(len(ranges), pa.string()), pa.nulls(len(ranges), pa.string()), pa.nulls(len(ranges), pa.int64())
                yield pa.RecordBatch.from_arrays([*none, pa.array(ranges, pa.int64()), pa.array(counts, pa.binary())], ["lang", "phrase", "n", "range", "counts"])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs):
                mine = (texts[i] for i in np.flatnonzero(langs == lang))
                for buffer, done in buffers(mine, longest - 1):
                    words = Words(lang, buffer)
                    parts = passes(words, n - 1, known) if n > 1 else None
                    ok = words.whole(n, done)
                    if n > 1:
                        ok &= passes(words, n, hot) & parts[: len(ok)] & parts[1:][: len(ok)]
                    values, counts = words.counted(n, ok)
                    held.append(pa.table({"lang": pa.array([lang] * len(values), pa.string()), "phrase": values, "n": counts}))
                    rows += len(values)
                    if n < longest:
                        # of n + 1 words, where both parts of n words may be frequent; the first may lie in the words carried over
                        may = words.whole(n) if n == 1 else words.whole(n) & passes(words, n, hot) & parts[: len(ok)] & parts[1:][: len(ok)]
                        wider = words.whole(n + 1, done)
                        wider &= may[: len(wider)] & may[1:][: len(wider)]
                        met.append(words.bucket(n + 1, bits)[wider].astype(np.uint32))
                        phrases_met += len(met[-1])
                        if phrases_met >= PACK:
                            yield from packed()
                            met, phrases_met = [], 0
            if rows > flush:
                held = [summed()]
                if len(held[0]) > flush // 2:
                    yield handed(held[0])
                    held = []
                else:
                    held = [held[0].rename_columns(["lang", "phrase", "n"])]
                rows = sum(map(len, held))
        if held:
            table = summed()
            for i in range(0, len(table), 1 << 16):
                yield handed(table.slice(i, 1 << 16))
        if met:
            yield from packed()

    return count


def _buckets_of(n: int, bits: int):
    """The bucket of each phrase of n words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            phrases = batch.column("phrase").cast(pa.binary()).to_pylist()
            for lang in dict.fromkeys(langs):
                words = Words(lang, b"\n".join(phrases[i] for i in np.flatnonzero(langs == lang)))
                yield pa.RecordBatch.from_arrays([pa.array(words.bucket(n, bits)[words.whole(n)])], ["bucket"])

    return of


def bitmap(buckets: DataFrame, bits: int) -> bytes:
    """2**bits bits, set at each bucket (from 0) of the rows."""
    at = F.col("bucket") + 1
    parts = buckets.select("bucket", F.bitmap_bucket_number(at).alias("part")).repartition("part")  # else every task would hold every part
    parts = parts.groupBy("part").agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    return _joined(parts.select(F.col("part") - 1, "bits"), bits)  # at most 2**bits / 32768 rows of 4 KB


def hot_buckets(packed: DataFrame, bits: int, least: int) -> bytes:
    """2**bits bits, set at each bucket whose packed counts come to `least` or more."""
    low = _packing(bits, least)[0]

    def hot(counters: np.ndarray) -> bytes:
        return np.packbits(counters >= least, bitorder="little").tobytes()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counters = None, np.zeros(1 << low, np.int64)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([hot(counters)], pa.binary())], ["range", "bits"])
        for batch in batches:
            for key, data in zip(batch.column("range").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        yield done()
                    now = key
                    counters[:] = 0
                at, times = _unpack(data, bits, least)
                counters[at] += times
        if now is not None:
            yield done()

    ranges = packed.select("range", "counts").repartition("range").sortWithinPartitions("range").mapInArrow(add, "range bigint, bits binary")
    return _joined(ranges, bits)


def _joined(ranges: DataFrame, bits: int) -> bytes:
    found = bytearray(max(1, (1 << bits) // 8))
    for at, data in ranges.collect():
        found[at * len(data) : (at + 1) * len(data)] = data[: len(found)]
    return bytes(found)


def buckets_for(texts: DataFrame) -> int:
    """How many buckets the texts call for, as a power of two."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(BITS, (size // BUCKET).bit_length()))


def count_phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST, bits: int | None = None, flush: int = FLUSH) -> list[DataFrame]:
    """For n = 1 .. longest, (lang, phrase, n): all words, and every longer phrase that occurs at least `least` times."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bits = bits or buckets_for(texts)
    found: list[DataFrame] = []
    maps: list = [None, None]
    for n in range(1, longest + 1):
        parts = scratch.cut(texts.mapInArrow(_packed(n, longest, bits, maps, flush, least), PACKED), f"pass{n}")
        counts = parts.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        counts = scratch.cut(counts if n == 1 else counts.where(F.col("n") >= least), f"counts{n}")
        found.append(counts)
        if n < longest:
            frequent = counts.where(F.col("n") >= least).mapInArrow(_buckets_of(n, bits), "bucket bigint")
            maps = [context.broadcast(x) for x in (bitmap(frequent, bits), hot_buckets(parts.where("range IS NOT NULL"), bits, least))]
        scratch.drop(f"pass{n}")
    return found


def _packed(n: int, longest: int, bits: int, maps: list, flush: int, least: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, bucket = (m.value if m is not None else None for m in maps)
        yield from _counting(n, longest, bits, frequent, bucket, flush, least)(batches)

    return count


def _pass(n: int, longest: int, bits: int, maps: list, flush: int):
    """A pass with its bucket counts as one row each, to look into."""
    most = 1 << 40
    low = _packing(bits, most)[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _packed(n, longest, bits, maps, flush, most)(batches):
            phrases = batch.filter(pc.is_valid(batch.column("phrase")))
            yield pa.RecordBatch.from_arrays([phrases.column("lang"), phrases.column("phrase"), pa.nulls(len(phrases), pa.int64()), phrases.column("n")], ["lang", "phrase", "bucket", "n"])
            packed = batch.filter(pc.is_valid(batch.column("range")))
            for key, data in zip(packed.column("range").to_pylist(), packed.column("counts").to_pylist(), strict=True):
                at, times = _unpack(data, bits, most)
                none = pa.nulls(len(at), pa.string())
                yield pa.RecordBatch.from_arrays([none, none, pa.array((key << low) + at), pa.array(times)], ["lang", "phrase", "bucket", "n"])

    return count


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def scored(counts: list[DataFrame], least: int = LEAST) -> DataFrame:
    """Every candidate (lang, phrase, a) with the parts l, r of its lowest-scoring cut and the score."""
    frequent = [c.where(F.col("n") >= least) for c in counts]
    parts = reduce(DataFrame.unionAll, frequent[:-1]).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    words = F.split("phrase", " ")
    cuts = F.sequence(F.lit(1), F.size(words) - 1)
    candidates = reduce(DataFrame.unionAll, frequent[1:]).select("lang", "phrase", F.col("n").alias("a"), words.alias("w"), F.explode(cuts).alias("k"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.array_join(F.slice("w", 1, F.col("k")), " ").alias("part")),
                    F.struct(F.lit(1).alias("side"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("part")))
    dealt = candidates.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.*")
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("f")))
    cut = dealt.join(parts, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    score = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    lowest = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return lowest.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """Candidates without those whose words lie inside a longer one that has at least `covered` per cent of their occurrences."""
    words, k = F.split("phrase", " "), F.size(F.split("phrase", " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), k - 1), lambda m: F.transform(F.sequence(F.lit(1), k - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    longer = candidates.where(k > 2).select("lang", F.col("a").alias("longer"), F.explode(inner).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    found = candidates.join(longer, ["lang", "phrase"], "left")
    return found.where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")


def first_of_each(rows: DataFrame, key: str, order: list[Column], top: int, scratch: Scratch) -> DataFrame:
    """The first `top` rows of each key in `order`, with `rank`; the order is total.

    Rows are dealt in ranges of (key, order), so that a key of any size is spread
    over many tasks; a range's ranks go on from the number of rows before it.
    """
    ranged = rows.repartitionByRange(F.col(key), *order).withColumn("range", F.spark_partition_id())
    ranged = scratch.cut(ranged, "ranged")
    sums = ranged.groupBy(key, "range").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).where(F.col("before") < top).drop("size")
    place = F.row_number().over(Window.partitionBy(key, "range").orderBy(*order))
    first = ranged.join(sums, [key, "range"]).withColumn("rank", F.col("before") + place).where(F.col("rank") <= top)
    return first.drop("range", "before")


def phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP,
            bits: int | None = None, flush: int = FLUSH) -> DataFrame:
    """Of each language the `top` collocations: lang, rank, phrase, a, l, r, n, score."""
    counts = count_phrases(docs, scratch, least, longest, bits, flush)
    words = counts[0].groupBy("lang").agg(F.sum("n").alias("n"))
    kept = scratch.cut(uncovered(scratch.cut(scored(counts, least), "scored"), covered), "kept")
    first = first_of_each(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, scratch)
    return first.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
