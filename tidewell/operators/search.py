"""Names that contain a text, found by a table of positional grams.

`postings` holds, for every place of a name, the q characters from there on
(fewer at the end).  A text of q characters or more stands in a name where its
own grams, q apart and one at its end, stand at the same distances; so the
table alone decides, and neither a scan of names nor a check against them is
needed.  A shorter text stands where a gram begins with it.  Stored sorted by
gram, the table is read by the few grams that a text has.

Postings are many times the names they are made of, which no estimate of their
size tells; so they are never what a join broadcasts.  Few grams of texts are
broadcast to them; many meet them in a merge join.

Defined results: null names and null texts match nothing; the empty text is in
every name that has a character; texts are compared as they are, by code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 3
FEW = 10_000  # grams of texts that are broadcast


def postings(rows: DataFrame, key: str, name: str, q: int = Q) -> DataFrame:
    """(gram, key, pos) of every place of every name."""
    places = F.explode(F.sequence(F.lit(1), F.char_length(name)))
    spread = rows.where(F.char_length(name) > 0).select(F.col(key).alias("key"), F.col(name).alias("_name"), places.alias("pos"))
    return spread.select(F.substr("_name", F.col("pos"), F.lit(q)).alias("gram"), "key", "pos")


def write(table: DataFrame, path: str) -> None:
    """Store postings so that a gram is in few row groups."""
    table.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key", "pos").write.mode("overwrite").parquet(path)


def _offsets(text: Column, q: int) -> Column:
    """Where the grams of a text begin that cover it, from 0: q apart, and the last at its end."""
    last = F.char_length(text) - q
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(q)), F.array(last)))


def _meeting(asked: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """The join of what texts ask for with postings, which are never gathered in one place."""
    few = asked.limit(FEW + 1).count() <= FEW
    return F.broadcast(asked).join(table, on) if few else asked.join(table.hint("merge"), on)


def contains(table: DataFrame, texts: DataFrame, text: str, q: int = Q) -> DataFrame:
    """(text, key) of every name that contains each of texts; texts may be many and meet the postings by gram."""
    asked = texts.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    long = asked.where(F.char_length("text") >= q).select("text", F.size(_offsets(F.col("text"), q)).alias("grams"), F.explode(_offsets(F.col("text"), q)).alias("offset"))
    long = long.withColumn("gram", F.substr("text", F.col("offset") + 1, F.lit(q)))
    met = _meeting(long, table, "gram").groupBy("text", "grams", "key", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    found = met.where(F.col("n") == F.col("grams")).select("text", "key")
    for size in range(1, q):  # a short text is the beginning of a gram
        short = asked.where(F.char_length("text") == size)
        found = found.unionAll(_meeting(short, table.select(F.substr("gram", F.lit(1), F.lit(size)).alias("text"), "key"), "text"))
    every = F.broadcast(asked.where("text = ''")).join(table.select(F.lit("").alias("text"), "key"), "text")  # one row at most
    return found.unionAll(every).distinct()


def contains_text(table: DataFrame, text: str, q: int = Q) -> DataFrame:
    """(key) of every name that contains one text; the filter on its grams reaches the scan."""
    if len(text) < q:
        return table.where(F.startswith("gram", F.lit(text))).select("key").distinct()
    offsets = sorted({*range(0, len(text) - q + 1, q), len(text) - q})
    grams = [text[i : i + q] for i in offsets]
    places = F.array(*[F.when(F.col("gram") == g, F.col("pos") - i) for g, i in zip(grams, offsets, strict=True)])
    starts = table.where(F.col("gram").isin(grams)).select("key", F.explode(F.array_compact(places)).alias("start"))
    return starts.groupBy("key", "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(offsets)).select("key").distinct()
