"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Sizes are at most CAPACITY, so an instance of any number of pieces is a
histogram of at most CAPACITY counts; only that histogram reaches the driver.
There a plan is made of *patterns*, each a tuple of sizes that share a sequence
and the number of sequences filled that way:

1. reduction: for a size, largest first, the sets that may share a sequence
   with it are compared.  A set dominates another if the other's pieces fit in
   the places of its own; a set that dominates all others is fixed for good and
   the instance shrinks.  The sets tried are the piece alone (nothing fits
   beside it), the pair with the largest size that fits (it fills the sequence,
   or no two pieces fit beside the first), and the triple of the largest size
   and the largest beside both (no three fit, and no pair of two sizes above
   the third fits);
2. best fit, largest first, of the remainder: a piece goes where the least room
   stays.

The pieces then find their places in parallel.  The tokenising tasks number
their pieces within each size; sums of those numbers over the tasks give every
piece its rank within its size, and the plan has, for each size, which ranks go
to which sequences at which offset.

Defined results: null text is empty, and an empty text is its end token alone;
repeated rows are packed each; an empty table gives an empty result; texts of
any length are cut whole into pieces, the short one first.
"""

from __future__ import annotations

import base64
import functools
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

CAPACITY = 1024
END = 2
SPECIAL = {"<|endoftext|>": 50256}

Pattern = tuple[int, ...]


class Reduction:
    """The instance: how many pieces of each size are not yet placed."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)
        self.capacity = capacity
        self.fixed: dict[Pattern, int] = Counter()

    def take(self, pattern: Pattern, times: int) -> None:
        for size, n in Counter(pattern).items():
            self.left[size] -= n * times
            if not self.left[size]:
                del self.left[size]
                self.sizes.remove(size)
        self.fixed[pattern] += times

    def largest(self, room: int, used: Pattern) -> int:
        """The largest size within room of which a piece is left beside those used; 0 if none."""
        for size in reversed(self.sizes[: bisect_right(self.sizes, room)]):
            if self.left[size] > used.count(size):
                return size
        return 0

    def smallest(self, n: int, used: Pattern, above: int = 0) -> int | None:
        """The sum of the n smallest pieces over `above`, beside those used; None if there are fewer."""
        total, need = 0, n
        for size in self.sizes[bisect_right(self.sizes, above) :]:
            k = min(need, self.left[size] - used.count(size))
            total, need = total + k * size, need - k
            if not need:
                return total
        return None

    def dominating(self, size: int) -> Pattern | None:
        """A set with this size that dominates every other such set, if the criteria find one."""
        room = self.capacity - size
        first = self.largest(room, (size,))
        if not first:
            return (size,)
        pair = (size, first)
        two = self.smallest(2, (size,))
        if first == room or two is None or two > room:
            return pair
        three = self.smallest(3, (size,))
        if three is not None and three <= room:
            return None
        second = self.largest(room - first, pair)
        if not second:  # two pieces fit, but none beside the largest: neither covers the other
            return None
        rival = self.smallest(2, (size,), above=second)
        return (*pair, second) if rival is None or rival > room else None

    def reduce(self) -> dict[Pattern, int]:
        for size in sorted(self.left, reverse=True):
            while self.left.get(size) and (pattern := self.dominating(size)):
                self.take(pattern, min(self.left[s] // n for s, n in Counter(pattern).items()))
        return self.fixed


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> dict[Pattern, int]:
    """Best fit decreasing over a histogram: alike sequences are handled together."""
    by_room: dict[int, Counter[Pattern]] = defaultdict(Counter)
    for size in sorted(counts, reverse=True):
        n = counts[size]
        for room in sorted(r for r in by_room if r >= size):
            if not n:
                break
            for pattern in list(by_room[room]):
                each = room // size  # a filled one has the least room, so it goes on being filled
                for k, times in ((each, min(by_room[room][pattern], n // each)), (n % each, 1)):
                    if k and times and k * times <= n and by_room[room][pattern] >= times:
                        by_room[room][pattern] -= times
                        by_room[room - k * size][pattern + (size,) * k] += times
                        n -= k * times
                if not n:
                    break
            by_room[room] = +by_room[room]
        each = capacity // size
        for k, times in ((each, n // each), (n % each, 1)):
            if k and times:
                by_room[capacity - k * size][(size,) * k] += times
    found: dict[Pattern, int] = Counter()
    for patterns in by_room.values():
        found.update(patterns)
    return +found


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[Pattern, int]:
    """Patterns and how many sequences follow each."""
    reduction = Reduction(counts, capacity)
    found = Counter(reduction.reduce())
    found.update(best_fit(reduction.left, capacity))
    return dict(sorted(found.items()))


def places(patterns: dict[Pattern, int]) -> dict[int, list[tuple[int, int, int]]]:
    """For each size: (first rank, sequence of that rank, offset), ranks and sequences running on together."""
    table: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = Counter()
    sequence = 0
    for pattern, times in patterns.items():
        offset = 0
        for size in pattern:
            table[size].append((used[size], sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    return table


@functools.cache
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def tokenizer(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids; a special token's name in a text is that token."""
    return functools.partial(_encoding(path).encode_to_numpy, allowed_special="all")


def pieces_of(ids: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of each piece; all but the first are full."""
    end = len(ids) % capacity or capacity
    yield 0, ids[:end]
    for start in range(end, len(ids), capacity):
        yield start, ids[start : start + capacity]


def _cut(path: str, capacity: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(path), np.array([END], np.uint32)
        part = TaskContext.get().partitionId()
        rank: dict[int, int] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows, out = [], defaultdict(list)
                for i, text in enumerate(some.column("text")):
                    for n, (start, ids) in enumerate(pieces_of(np.append(encode(text.as_py() or ""), end), capacity)):
                        rows.append(i)
                        out["piece"].append(n)
                        out["start"].append(start)
                        out["length"].append(len(ids))
                        out["ids_crc32"].append(zlib.crc32(ids.astype("<u4", copy=False)))
                        out["rank"].append(rank[len(ids)])
                        rank[len(ids)] += 1
                        if with_ids:
                            out["ids"].append(ids.astype(np.int32))
                kept = some.select([0]).take(pa.array(rows, pa.int32()))
                columns = [pa.array([part] * len(rows), pa.int32())]
                columns += [pa.array(out[c], pa.int32() if c == "piece" else pa.int64()) for c in ("piece", "start", "length", "ids_crc32", "rank")]
                names = ["row", "part", "piece", "start", "length", "ids_crc32", "rank"]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([kept.column(0), *columns], names)

    return cut


def _place(table: dict[int, list[tuple[int, int, int]]]):
    """Add sequence_id and offset by the rank among the pieces of a size."""
    arrays = {size: np.array(rows, np.int64).T for size, rows in table.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length):
                mine = length == size
                first, begins, offsets = arrays[int(size)]
                at = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine], offset[mine] = begins[at] + rank[mine] - first[at], offsets[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"]
            )

    return place


def pack(docs: DataFrame, scratch: Scratch, carry: Iterable[str] = ("doc_id",), capacity: int = CAPACITY,
         with_ids: bool = False, path: str | None = None) -> DataFrame:
    """A row (the carried columns of its document) for each piece, with its place; with_ids adds the token ids."""
    made = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    carry = [c for c in carry if c not in made]
    path = path or str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = docs.select(F.struct(F.lit(0).alias("_"), *carry).alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, part int, piece int, start bigint, length bigint, ids_crc32 bigint, rank bigint" + ", ids array<int>" * with_ids
    pieces = scratch.cut(rows.mapInArrow(_cut(path, capacity, with_ids), schema), "pieces")

    sums = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = scratch.cut(sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "sums")
    counts = dict(sums.groupBy("length").agg(F.sum("n")).collect())  # at most `capacity` rows
    table = places(plan(counts, capacity))

    ranked = pieces.join(sums.select("part", "length", "before"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("row", "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if with_ids else []))
    schema = f"row {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, rank bigint" + ", ids array<int>" * with_ids
    placed = ranked.mapInArrow(_place(table), f"{schema}, sequence_id bigint, offset bigint")
    return placed.select(*[F.col("row")[c].alias(c) for c in carry], *made)
