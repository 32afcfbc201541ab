"""Sharding by extendible hashing.

Rows get a 60-bit hash; a shard is a prefix of it.  The directory starts at the
empty prefix, and only a bucket over the byte limit is split, on its next bit,
until every bucket fits.  Splitting is a search on sums, not a movement of
rows: a round adds up bytes by the next DIGIT bits, adds those few numbers up
once more for every shorter prefix, and keeps for each the shortest prefix that
fits; the next round looks only at the prefixes that no depth has made fit.
Rows are joined to the directory by their round's digits.

Rows with one hash cannot be parted by it.  Where they exceed the limit they
are dealt into numbered overflow shards, as many rows to each as fit by the
largest of them; they are numbered within the file parts of the row table, so a
hash with very many rows is not gathered.  A row over the limit has a shard of
its own.

Defined results: null text has no bytes; null doc_id hashes as an empty string;
repeated rows have one hash, hence are overflow if they exceed the limit; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

LIMIT = 1 << 20
BITS = 60
DIGIT = 12  # bits a round


def row_hash() -> Column:
    """60 bits of md5(doc_id:md5(text)) as a string of 0 and 1."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))
    return F.lpad(F.conv(F.substring(digest, 1, BITS // 4), 16, 2), BITS, "0")


def directory(light: DataFrame, limit: int, scratch: Scratch) -> list[DataFrame]:
    """For each round (cell, shard, shard_bytes, shard_rows): the cells of its digits that end there."""
    found, now = [], light.select("hash", "bytes")
    for at in range(0, BITS, DIGIT):
        width = at + DIGIT
        cells = now.groupBy(F.substring("hash", 1, width).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        cells = scratch.cut(cells, f"cells{at}")
        depths = cells.select("*", F.explode(F.sequence(F.lit(at), F.lit(width))).alias("depth"))
        depths = depths.withColumn("shard", F.substring("cell", F.lit(1), F.col("depth")))
        totals = depths.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = totals.where((F.col("shard_bytes") <= limit) | (F.length("shard") == BITS))
        ends = depths.join(fits, "shard").groupBy("cell").agg(F.min_by(F.struct("shard", "shard_bytes", "shard_rows"), "depth").alias("s"))
        ends = scratch.cut(ends.select("cell", "s.*"), f"ends{at}")
        found.append(ends)
        over = cells.join(ends, "cell", "left_anti")
        if over.isEmpty():
            break
        now = now.join(over.select("cell"), F.substring("hash", 1, width) == F.col("cell"), "left_semi")
    return found


def shard(docs: DataFrame, scratch: Scratch, carry: Iterable[str] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """Every row (its carried columns) with bytes, shard (hash-prefix bits; '.n' after those of an overflow), shard_bytes, shard_rows."""
    carry = [c for c in carry if c not in ("bytes", "shard", "shard_bytes", "shard_rows")]
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    rows = docs.select(F.struct(F.lit(0).alias("_"), *carry).alias("row"), row_hash().alias("hash"), size.alias("bytes"))
    rows = scratch.cut(rows.withColumn("part", F.spark_partition_id()), "rows")
    placed = []
    for i, ends in enumerate(directory(rows, limit, scratch)):
        digits = F.substring("hash", 1, (i + 1) * DIGIT)
        placed.append(rows.join(ends, digits == F.col("cell")).drop("cell"))
    fit = placed[0].where(F.col("shard_bytes") <= limit)
    for more in placed[1:]:
        fit = fit.unionAll(more.where(F.col("shard_bytes") <= limit))
    columns = [F.col("row")[c].alias(c) for c in carry]
    out = fit.select(*columns, "bytes", F.concat(F.lit("/"), "shard").alias("shard"), "shard_bytes", "shard_rows")
    if len(placed) * DIGIT < BITS:
        return out

    spill = scratch.cut(placed[-1].where(F.col("shard_bytes") > limit), "spill")
    number = F.row_number().over(Window.partitionBy("hash", "part").orderBy("bytes"))
    parts = spill.groupBy("hash", "part").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("most"))
    whole = Window.partitionBy("hash")
    parts = parts.withColumns(
        {"before": F.sum("n").over(whole.orderBy("part")) - F.col("n"), "each": F.greatest(F.lit(1), F.floor(limit / F.greatest(F.max("most").over(whole), F.lit(1))))}
    )
    spill = spill.withColumn("number", number - 1).join(parts.select("hash", "part", "before", "each"), ["hash", "part"])
    page = F.floor((F.col("number") + F.col("before")) / F.col("each"))
    spill = spill.withColumn("shard", F.concat(F.lit("/"), "hash", F.lit("."), page.cast("string")))
    totals = spill.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    spill = spill.drop("shard_bytes", "shard_rows").join(totals, "shard")
    return out.unionAll(spill.select(*columns, "bytes", "shard", "shard_bytes", "shard_rows"))
