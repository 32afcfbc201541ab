"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint is the 64-bit majority vote of its word shingles' XXH64.
Fingerprints link at RADIUS or fewer differing bits.  Bit i is given a non-zero
vector m(i) of RADIUS + 1 bits, and table v keeps the bits with <m(i), v> = 1.
The vectors of at most RADIUS differing bits span a proper subspace, so some
v is orthogonal to all of them and that table keeps none of the differing bits:
every linked pair shares a bucket in at least one of the 2^(RADIUS+1) - 1
tables, with no false negatives.

Equal fingerprints are one node (pre-aggregated, however many copies share
it).  A bucket of up to BUCKET nodes is resolved inside its row and gives a
spanning star per local component, never its pairs.  A larger bucket goes the
exact second way: two words differ in at most four bits if and only if some
third word lies within two bits of both, so each node names the words within
two flips of it among the bits that the table leaves free, and nodes that name
the same word are linked; at most 1 + f + f(f-1)/2 nodes can name one word.

Defined results: null and empty texts have fingerprint zero; fewer words than a
shingle count as one shingle; repeated rows share a component, and one of them
is its first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .scratch import Scratch

SHINGLE = 4
SEED = 42
RADIUS = 4
BUCKET = 512
LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_LANES = np.uint64(0x0101010101010101)
_SHIFTS = np.arange(8, dtype=np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks() -> list[int]:
    """The bits that each table keeps."""
    vector = [1 + i % (2 ** (RADIUS + 1) - 1) for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in range(1, 2 ** (RADIUS + 1))]


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII blanks
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: 1 - size].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], SEED) for i, j in zip(first, last, strict=True)]


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed long."""
    if not len(hashes):
        return 0
    votes = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), 255 * 64):  # a lane of a byte holds 255 votes
        lanes = (hashes[at : at + 255 * 64, None] >> _SHIFTS) & _LANES
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        votes += np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 8, 8).sum(axis=0, dtype=np.int64)
    bits = 2 * votes > len(hashes)  # [bit of the byte, byte]
    return _signed(sum(1 << int(8 * byte + bit) for bit, byte in np.argwhere(bits)))


def fingerprint(text: bytes) -> int:
    return majority(np.array(shingle_hashes(text), np.uint64))


@F.arrow_udf(T.LongType())
def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array((fingerprint(x.as_py()) for x in batch), pa.int64(), size=len(batch))


@F.arrow_udf(T.ArrayType(LINK))
def spanning_links(buckets: pa.Array) -> pa.Array:
    """For each list of nodes: a star for each set of nodes chained by links."""
    out = []
    for nodes in buckets.to_pylist():
        x = np.array(sorted(nodes), np.int64)
        near = np.bitwise_count(x[:, None].view(np.uint64) ^ x[None, :].view(np.uint64)) <= RADIUS
        root = np.arange(len(x))
        while True:
            low = np.where(near, root[None, :], len(x)).min(axis=1)
            low = low[low]
            if (low == root).all():
                break
            root = low
        out.append([{"a": int(x[i]), "b": int(x[r])} for i, r in enumerate(root) if i != r])
    return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))


def links(nodes: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(a, b) that connect exactly the nodes (fp, distinct) chained by links."""
    spark, masks = scratch.spark, _masks()
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])
    dealt = nodes.select("fp", F.posexplode(keys).alias("t", "key"))
    full = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # rows of 31 tables, which Spark takes for as few bytes as the nodes have: left to it, the driver would gather and broadcast them
    dealt = scratch.cut(dealt.join(full.hint("merge"), ["t", "key"]), "buckets")

    small = dealt.where(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("nodes"))
    small = small.select(F.explode(spanning_links("nodes")).alias("e")).select("e.*")

    flips = []
    for t, mask in enumerate(masks):
        free = [1 << i for i in range(64) if not mask >> i & 1]
        flips.append((t, [0, *map(_signed, free), *(_signed(a | b) for a, b in combinations(free, 2))]))
    ways = F.broadcast(spark.createDataFrame(flips, "t int, flips array<bigint>"))  # 31 rows
    large = dealt.where(F.col("n") > bucket).join(ways, "t").select("fp", F.explode("flips").alias("flip"))
    large = large.groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("word")).agg(F.collect_set("fp").alias("nodes"))
    large = large.where(F.size("nodes") > 1).select(F.explode("nodes").alias("a"), F.array_min("nodes").alias("b"))
    return small.unionAll(large.where("a <> b"))


def near_duplicates(docs: DataFrame, scratch: Scratch, carry: Iterable[str] = ("doc_id",), bucket: int = BUCKET) -> DataFrame:
    """Every row of docs with fingerprint, component_id, first (one row of each component, with its smallest doc_id)."""
    carry = [c for c in carry if c not in ("fingerprint", "component_id", "first")]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(F.lit(0).alias("_"), *carry).alias("row"), F.col("doc_id").alias("id"), fingerprints(text).alias("fp"))
    rows = scratch.cut(rows.withColumn("rid", F.monotonically_increasing_id()), "fingerprints")

    lowest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("lowest")
    nodes = scratch.cut(rows.groupBy("fp").agg(lowest), "nodes")
    roots = connected_components(links(nodes.select("fp"), scratch, bucket), scratch)
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "lowest")
    heads = rooted.groupBy("root").agg(F.min("lowest").alias("lowest"))
    heads = rooted.select("fp", "root").join(heads, "root").select("fp", "lowest")
    return rows.join(heads, "fp").select(
        *[F.col("row")[c].alias(c) for c in carry],
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("lowest")["id"].alias("component_id"),
        (F.col("lowest")["rid"] == F.col("rid")).alias("first"),
    )
