"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A byte-level vocabulary writes each of the 256 bytes as a printable character;
tokens are strings of these.  The tokenizer is made from a rank file: the
vocabulary maps every token's characters to its rank, and the merges are all
ways to make a token of two others, in the order of ranks, which is the order
in which a rank-driven encoder merges.  Texts are first split by the pattern,
and each match is encoded by itself; no string is a special token.

No match of the pattern holds anything before a blank, so a place between a
character that is no white space and a blank always parts two matches.  A batch
is cut into units at such places, equal units are found by Arrow, and each is
encoded once; the ids of a text are those of its units.

Encoding gives ids and, if asked, offsets: where each token begins and ends in
the text, in code points.  A character of several bytes may be split between
tokens, which then have offsets that overlap in it.  Decoding looks up the
bytes of each id by the reversed byte table and joins them; as text, the bytes
of a split character belong to the token that completes it, and what never
becomes a character is shown as U+FFFD.

Defined results: a null text is empty and has no ids; repeated rows are encoded
each; an empty table gives an empty result; texts of any length are encoded
whole; names that look like special tokens are plain text; null ids decode to
null.  An id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import codecs
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

GROUP = 1 << 16  # characters that are encoded together
RANKS = "byte_bpe_50k.tiktoken"
BATCH = 1 << 22  # bytes of texts that are cut into units together
MEMO = 200_000  # units whose ids a task remembers
_CUT = re.compile(r"\S(?= )")


@functools.cache
def byte_characters() -> tuple[str, ...]:
    """The printable character of each byte: itself if it is one, else the next free code point from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return tuple(chr(b) if b in shown else chr(next(free)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def as_characters(token: bytes) -> str:
    return "".join(map(byte_characters().__getitem__, token))


def merges(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """Every pair of tokens that makes a token, by the rank of what it makes."""
    found = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                found.append((as_characters(token[:i]), as_characters(token[i:])))
    return found


def as_bytes(characters: str) -> bytes:
    return bytes(map(_bytes().__getitem__, characters))


@functools.cache
def _bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_characters())}


@functools.cache
def tokenizer(path: str, pattern: str = public_tokenizers.PATTERN):
    """A tokenizer of the library, from a rank file; once a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    made = Tokenizer(models.BPE({as_characters(t): r for t, r in ranks.items()}, merges(ranks)))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return made


@functools.cache
def token_bytes(path: str) -> pa.LargeBinaryArray:
    """The bytes of each id, by the reversed byte table."""
    vocabulary = tokenizer(path).get_vocab()
    return pa.array(map(as_bytes, sorted(vocabulary, key=vocabulary.__getitem__)), pa.large_binary())


def parts(text: str, size: int = GROUP) -> Iterator[tuple[int, str]]:
    """(place, part) of a text, cut where two matches of the pattern part, each of `size` characters or little more."""
    start = 0
    while len(text) - start > size and (found := _CUT.search(text, start + size)):
        yield start, text[start : found.end()]
        start = found.end()
    yield start, text[start:]


def _black(data: np.ndarray) -> np.ndarray:
    """Whether each byte ends a character that is told to be no white space: ASCII, two bytes from C3 on, three from E4 on; of others it is left open."""
    black = (data > 0x20) & (data < 0x7F)
    tail = (data >= 0x80) & (data < 0xC0)
    black[1:] |= tail[1:] & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    black[2:] |= tail[2:] & tail[1:-1] & (data[:-2] >= 0xE4) & (data[:-2] < 0xF0)
    return black


def _parted(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where units begin, and the end: at the rows' own starts, and at each blank behind what is no white space."""
    at = data == 0x20
    at[1:] &= _black(data)[:-1]
    at[rows[rows < len(data)]] = True
    return np.append(np.flatnonzero(at), len(data))


def _buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ends with a 0 before, bytes) of a large binary array."""
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return ends - ends[0], data


class Memo:
    """The ids of units seen lately; forgotten when there are too many."""

    def __init__(self, path: str):
        self.path, self.lengths = path, pc.binary_length(token_bytes(path)).to_numpy()
        self.forget()

    def forget(self) -> None:
        self.units, self.ids = pa.array([], pa.large_binary()), pa.array([], pa.large_list(pa.int32()))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, units: pa.Array) -> pa.Array:
        """The ids of units that part from each other when they stand end to end; told apart by the bytes of the tokens."""
        ends, data = _buffers(units)
        cuts = ends[np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + GROUP, GROUP)).clip(max=len(ends) - 1))]
        texts = [data[i:j].tobytes().decode() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        ids = np.concatenate([np.zeros(0, np.int32), *self._encode(texts)])
        return _listed(np.searchsorted(np.cumsum(self.lengths[ids]), ends, "right"), ids)

    def _apart(self, units: pa.Array) -> pa.Array:
        texts = units.cast(pa.large_string()).to_pylist()
        ids = [x for i in range(0, len(texts), 1024) for x in self._encode(texts[i : i + 1024])]
        return _listed(np.cumsum([0, *map(len, ids)]), np.concatenate([np.zeros(0, np.int32), *ids]))

    def lookup(self, units: pa.Array) -> pa.Array:
        """The ids of each of distinct units, a list each."""
        if len(self.units) > MEMO or self.units.nbytes > 64 * MEMO:
            self.forget()
        new = units.filter(pc.invert(pc.is_in(units, self.units)))
        ends, data = _buffers(new)
        part = pa.array((data[ends[:-1]] == 0x20) & _black(data)[ends[1:] - 1])  # begins with a blank and ends with none
        for some, encode in ((new.filter(part), self._together), (new.filter(pc.invert(part)), self._apart)):
            if len(some):
                self.units, self.ids = pa.concat_arrays([self.units, some]), pa.concat_arrays([self.ids, encode(some)])
        return self.ids.take(pc.index_in(units, self.units))


def _listed(ends: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids))


def encode_texts(texts: pa.Array, memo: Memo) -> pa.Array:
    """The ids of each text; equal units of texts, mostly words, are encoded once."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")]).cast(pa.large_binary())
    rows = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2] or pa.py_buffer(b"")
    bounds = _parted(np.frombuffer(data, np.uint8)[rows[0] : rows[-1]], rows[:-1] - rows[0]) + rows[0]
    units = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), data]).dictionary_encode()
    ids = memo.lookup(units.dictionary).take(units.indices)
    ends = ids.offsets.to_numpy()[np.searchsorted(bounds, rows)]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids.values)


def groups(texts: pa.Array, size: int = BATCH) -> Iterator[pa.Array]:
    """The texts in order, as many together as hold `size` bytes, or one."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(sizes, size + (sizes[start - 1] if start else 0), "right")))
        yield texts.slice(start, end - start)
        start = end


def encode(text: Column, path: str | None = None) -> Column:
    """The ids of a text, array<int>."""
    path = path or str(public_tokenizers.path(RANKS))

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = Memo(path)
        for texts in batches:
            yield pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(encode_texts(x, memo) for x in groups(texts))])

    return ids(text)


def offsets_of(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text, and (begin, end) of each token."""
    found = [(place, tokenizer(path).encode(part, add_special_tokens=False)) for place, part in parts(text)]
    spans = [np.array(x.offsets, np.int32).reshape(-1, 2) + place for place, x in found]
    return np.concatenate([np.array(x.ids, np.int32) for _, x in found]), np.concatenate(spans)


def encode_with_offsets(text: Column, path: str | None = None) -> Column:
    """struct<ids, begins, ends>: where each token begins and ends in the text, in code points."""
    path = path or str(public_tokenizers.path(RANKS))
    kind = pa.struct([(c, pa.list_(pa.int32())) for c in ("ids", "begins", "ends")])

    @F.arrow_udf("struct<ids:array<int>,begins:array<int>,ends:array<int>>")
    def tokens(texts: pa.Array) -> pa.Array:
        found = (offsets_of(x.as_py() or "", path) for x in texts)
        return pa.array(({"ids": ids, "begins": spans[:, 0], "ends": spans[:, 1]} for ids, spans in found), kind, size=len(texts))

    return tokens(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes of ids, binary; not always whole characters."""
    path = path or str(public_tokenizers.path(RANKS))

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        found = token_bytes(path).take(lists.flatten())
        return _rows(lists, np.frombuffer(found.buffers()[1], np.int64)[found.offset :], found.buffers()[2])

    return joined(ids)


def packed(ids: Column) -> Column:
    """Ids as little-endian unsigned 32-bit integers end to end, binary."""

    @F.arrow_udf("binary")
    def bytes_of(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        return _rows(lists, np.arange(len(flat) + 1, dtype=np.int64) * 4, pa.py_buffer(flat))

    return bytes_of(ids)


def _rows(lists: pa.Array, ends: np.ndarray, data: pa.Buffer) -> pa.Array:
    """For each list the bytes of its elements, which lie end to end in data; null for null."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = ends[np.concatenate(([0], np.cumsum(counts)))].astype(np.int64)
    rows = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at), data])
    return pc.if_else(lists.is_valid(), rows, None).cast(pa.binary())


def texts_of(tokens: list[bytes]) -> list[str]:
    """The text that each token adds; a split character comes with the token that completes it."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    return [decoder.decode(t, i == len(tokens) - 1) for i, t in enumerate(tokens)]


def decode_tokens(ids: Column, path: str | None = None) -> Column:
    """The text that each id adds, array<string>; joined, the text of all."""
    path = path or str(public_tokenizers.path(RANKS))

    @F.arrow_udf("array<string>")
    def texts(lists: pa.Array) -> pa.Array:
        table = token_bytes(path)
        return pa.array((None if x is None else texts_of(table.take(pa.array(x, pa.int64())).to_pylist()) for x in lists.to_pylist()), pa.list_(pa.string()), size=len(lists))

    return texts(ids)
