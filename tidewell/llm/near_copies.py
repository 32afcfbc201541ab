"""Near copies by SimHash, checked and completed by exact Jaccard similarity of word shingles.

A text is the set of the XXH64 of its runs of five words; two texts are linked
at a Jaccard similarity of at least 0.8, and linked texts chain into components.
The first candidates come from fingerprints, the majority vote of such a set,
by op1's covering tables: each is held against the nearest that its buckets
link it to, equal ones against one of them.  A similarity decides, not the bits:
at 0.8 fingerprints differ in about ten of 64 bits, and covering a radius r
takes 2^(r+1) - 1 tables, so those beyond the radius are found by prefixes.

Under one global order of the shingles, two sets of similarity t or more share
a shingle among the first n - ceil(t n) + 1 of each, n being its size.  So no
linked pair is missed, and what is linked already need not meet again.

The order puts common shingles last; which are common is guessed from some of
the documents, as any order gives the same links.  A bucket of one shingle is
first held against its highest member and its middle one: that with the fewest
shingles before the shared one.  Variants of one text have rare shingles of
their own there, the text itself has none, so it meets all of its variants.
These pairs are checked along with the fingerprints', as texts move but once.
Next come drawn members, turn by turn, as long as a turn lowers the pairs of
members in different components by an eighth.  Only such members then meet each
other, and of these only such as the sizes and the places of the shared shingle
allow: the smaller set (n) must have it among its first
n - ceil(2t / (1 + t) n) + 1, and what follows it in either must still reach the
similarity.  Histograms of the shingles, of one or two to a bin, then bound the
similarity from above, so that few texts are compared.

Defined results: null and empty texts are copies of each other; fewer words
than a shingle count as one shingle; repeated rows share a component, and one
of them is its first; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .scratch import Scratch
from .simhash_dedup import links as covering_links
from .simhash_dedup import majority, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
GUESS_PART = 16  # common shingles are looked for in one document of so many
COMMON = 2  # that many of those hold a common shingle
MAX_COMMON = 200_000
PIVOTS = 16  # members that most others of a large group meet in a turn
PREFIX = T.StructType(
    [T.StructField("same", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("hist", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]
)


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted and distinct, as signed longs."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64)).view(np.int64)


def prefix(found: np.ndarray, common: np.ndarray, least: Fraction) -> np.ndarray:
    """The shingles of which a set linked to this one has one in its own prefix."""
    if not len(found):
        return found
    keep = len(found) - math.ceil(least * len(found)) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        found = found[np.argsort(common[at] == found, kind="stable")]
    return found[:keep]


def _bits(n: int) -> int:
    """There are 2 ** bits bins for n shingles: one or two to a bin."""
    return max(4, n.bit_length() - 1)


def histogram(found: np.ndarray) -> bytes:
    """Counts by the upper bits, of one byte each if that holds them, else of four."""
    bits = _bits(len(found))
    counts = np.bincount((found.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u4").tobytes()


def most_shared(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """An upper bound of the shingles that two sets of these histograms share."""
    counts = []
    for hist, n in ((a, n_a), (b, n_b)):
        counts.append(np.frombuffer(hist, "u1" if len(hist) == 1 << _bits(n) else "<u4").astype(np.int64))
    bins = min(map(len, counts))
    x, y = (c.reshape(bins, -1).sum(axis=1) for c in counts)
    return int(np.minimum(x, y).sum())


def similar(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least.denominator >= least.numerator * (len(a) + len(b) - both)


def close_fingerprints(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) of nodes (node, fp) to compare: one for each node that shares its fingerprint, one for each fingerprint linked to another."""
    own = Scratch(scratch.spark)
    fps = own.cut(nodes.groupBy("fp").agg(F.min("node").alias("head")), "fingerprints")
    equal = nodes.join(fps, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("bits")
    near = covering_links(fps.select("fp"), own).groupBy("a").agg(F.min(F.struct(bits, "b"))["b"].alias("b"))
    near = near.join(fps.toDF("a", "head_a"), "a").join(fps.toDF("b", "head_b"), "b")
    near = near.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))
    found = scratch.cut(equal.unionAll(near), "close_fingerprints")
    own.clear()
    return found


def _links(rows: DataFrame, extra: DataFrame, close: DataFrame, scratch: Scratch, shingle: int, least: Fraction) -> DataFrame:
    """(a, b) that connect exactly the chained rows (rid, n, hist, keys, text), the pairs of close first; the rids of extra stand aside, as copies of others."""
    num, den = least.numerator, least.denominator

    @F.arrow_udf(T.BooleanType())
    def possible(left: pa.Array, n_left: pa.Array, right: pa.Array, n_right: pa.Array) -> pa.Array:
        pairs = zip(*(x.to_pylist() for x in (left, n_left, right, n_right)), strict=True)
        return pa.array([(num + den) * most_shared(a, m, b, n) >= num * (m + n) for a, m, b, n in pairs], pa.bool_())

    @F.arrow_udf(T.BooleanType())
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        out, known, text = [], None, None
        for a, b in zip(left, right, strict=True):
            a, b = a.as_py(), b.as_py()
            if a != text:
                text, known = a, shingle_set(a, shingle)
            out.append(similar(known, shingle_set(b, shingle), least))
        return pa.array(out, pa.bool_())

    def check(pairs: DataFrame, name: str) -> DataFrame:
        sizes, hists = rows.select("rid", "n"), rows.select("rid", "hist")
        pairs = pairs.where("a < b").distinct().join(sizes.toDF("a", "n_left"), "a").join(sizes.toDF("b", "n_right"), "b")
        n, m = F.least("n_left", "n_right"), F.greatest("n_left", "n_right")
        pairs = scratch.cut(pairs.where(n * den >= m * num), f"{name}_sized")
        pairs = pairs.join(hists.toDF("a", "left"), "a").join(hists.toDF("b", "right"), "b")
        pairs = pairs.where(possible("left", "n_left", "right", "n_right"))
        pairs = scratch.cut(pairs.select("a", "b"), f"{name}_pairs")
        named = scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), f"{name}_named")
        some = scratch.cut(rows.select("rid", "text").join(named, "rid", "left_semi"), f"{name}_texts")  # texts move once
        pairs = pairs.join(some.toDF("a", "left"), "a").join(some.toDF("b", "right"), "b")
        found = scratch.cut(pairs.where(linked("left", "right")).select("a", "b"), name)
        for made in ("sized", "pairs", "named", "texts"):
            scratch.drop(f"{name}_{made}")
        return found

    shared = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    dealt = rows.select("rid", "n", F.posexplode("keys").alias("at", "key")).join(shared.hint("merge"), "key")  # one way at every size
    buckets = scratch.cut(dealt.join(extra, "rid", "left_anti"), "buckets")  # few keys are left, so copies go here
    ends = buckets.groupBy("key").agg(F.min(F.struct("at", "rid"))["rid"].alias("middle"), F.max("rid").alias("hi"), F.count(F.lit(1)).alias("members"))
    ended = buckets.select("key", "rid").join(ends.where("members > 1").hint("merge"), "key")
    ended = ended.select("rid", F.explode(F.array("middle", "hi")).alias("end")).select(F.least("rid", "end").alias("a"), F.greatest("rid", "end").alias("b"))
    links = check(close.unionAll(ended), "first_links")

    def mixed(members: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """The members of the buckets that hold several components, each with its root."""
        own = Scratch(scratch.spark)
        placed = members.select("key", "node", "n", "at").join(connected_components(links, own), "node", "left")
        placed = scratch.cut(placed.select("key", "node", "n", "at", F.coalesce("root", "node").alias("root")), f"{name}_placed")
        own.clear()
        several = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("members"))
        found = scratch.cut(placed.join(several.where("x <> y AND members > 2").select("key"), "key"), name)  # two have met
        scratch.drop(f"{name}_placed")
        return found

    def left(parts: DataFrame) -> float:
        """About twice the pairs of members in one bucket and different components."""
        roots = parts.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("n"))
        keys = roots.groupBy("key").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("pairs"))
        return keys.agg(F.sum("pairs")).first()[0] or 0.0

    parts = mixed(buckets.withColumnRenamed("rid", "node"), links, "mixed0")
    scratch.drop("buckets")
    turn, before, now = 0, 0, left(parts)
    while now and (not turn or 8 * now <= 7 * before):
        turn += 1
        order = F.xxhash64("node", F.lit(turn), F.pmod("key", F.lit(PIVOTS)))  # buckets of the same members take up to so many
        pivots = parts.groupBy("key").agg(F.min(F.struct(order.alias("order"), "node", "root")).alias("pivot"))
        held = parts.join(pivots.hint("merge"), "key").where("root <> pivot.root")
        found = check(held.select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")), f"links{turn}")
        links = links.unionAll(found)
        parts = mixed(parts, links, f"mixed{turn}")
        scratch.drop(f"mixed{turn - 1}")
        before, now = now, left(parts)
    small = parts.where(F.col("at") * (num + den) <= F.col("n") * (den - num))  # in whole numbers, as all of these
    p, q = (df.toDF("key", *[f"{c}_{x}" for c in ("node", "n", "at", "root")]) for df, x in ((small, "p"), (parts, "q")))
    follow = F.least(F.col("n_p") - F.col("at_p"), F.col("n_q") - F.col("at_q"))  # the shared one and those after it
    allowed = (
        (F.col("root_p") != F.col("root_q")) & ((F.col("n_p") < F.col("n_q")) | ((F.col("n_p") == F.col("n_q")) & (F.col("node_p") < F.col("node_q"))))
        & (F.col("n_p") * den >= F.col("n_q") * num) & (follow * (num + den) >= (F.col("n_p") + F.col("n_q")) * num)
    )
    pairs = p.join(q, "key").where(allowed).select(F.least("node_p", "node_q").alias("a"), F.greatest("node_p", "node_q").alias("b"))
    return links.unionAll(check(pairs, "rest_links"))


def near_copies(docs: DataFrame, scratch: Scratch, carry: Iterable[str] = ("doc_id",), shingle: int = SHINGLE,
                similarity: float = SIMILARITY) -> DataFrame:
    """Every row of docs with component_id, first (one row of each component, with its smallest doc_id)."""
    least = Fraction(str(similarity))
    carry = [c for c in carry if c not in ("component_id", "first")]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def shingles(texts: pa.Array) -> pa.Array:
        return pa.array((shingle_set(x.as_py(), shingle) for x in texts), pa.list_(pa.int64()), size=len(texts))

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(GUESS_PART)) == 0)
    common = some.select(F.explode(shingles(text)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    common = common.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "key").limit(MAX_COMMON).select("key").toPandas()["key"]
    common = np.sort(common.to_numpy(np.int64))

    @F.arrow_udf(PREFIX)
    def prefixes(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            found = shingle_set(x.as_py(), shingle)
            out.append({"same": xxhash.xxh3_128_digest(found.tobytes()), "n": len(found), "fp": majority(found.view(np.uint64)), "hist": histogram(found), "keys": prefix(found, common, least)})
        kind = pa.struct([("same", pa.binary()), ("n", pa.int32()), ("fp", pa.int64()), ("hist", pa.binary()), ("keys", pa.list_(pa.int64()))])
        return pa.array(out, kind, size=len(texts))

    own = [] if "text" in carry else [F.col("text")]  # once is enough
    rows = docs.select(F.struct(F.lit(0).alias("_"), *carry).alias("row"), F.col("doc_id").alias("id"), *own, prefixes(text).alias("p"))
    rows = scratch.cut(rows.select("row", "id", *["text" for _ in own], "p.*").withColumn("rid", F.monotonically_increasing_id()), "prefixes")

    lowest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("lowest")
    nodes = rows.groupBy("same").agg(lowest, F.min("rid").alias("node"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("copies"))
    nodes = scratch.cut(nodes, "nodes")
    extra = rows.select("same", "rid").join(nodes.where("copies > 1").select("same", "node"), "same").where("rid <> node")
    extra = scratch.cut(extra.select("rid"), "extra")
    kept_text = F.coalesce(F.col("text") if own else F.col("row")["text"], F.lit("")).cast("binary")
    close = close_fingerprints(nodes.select("node", "fp"), scratch)
    links = _links(rows.select("rid", "n", "hist", "keys", kept_text.alias("text")), extra, close, scratch, shingle, least)
    roots = connected_components(links, scratch)
    rooted = nodes.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("root"), "lowest", "copies")
    heads = rooted.groupBy("root").agg(F.min("lowest").alias("lowest"), F.sum("copies").alias("members")).where("members > 1")
    heads = scratch.cut(rooted.select("same", "root").join(heads, "root").select("same", "lowest"), "heads")  # of rows that have a copy
    head = F.coalesce("lowest", F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
    return rows.join(heads.hint("merge"), "same", "left").select(
        *[F.col("row")[c].alias(c) for c in carry],
        head["id"].alias("component_id"),
        (head["rid"] == F.col("rid")).alias("first"),
    )
