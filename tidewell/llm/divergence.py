"""Source divergence audit: how far the sources of a language are from each other, and by which terms.

Terms are runs of letters; of each language those in at least ``least`` of its
documents are kept.  Every group (language, source) gives every kept term a
smoothed share in whole billionths, those it never uses included, and two
groups, or a group and its language, are compared by the sum over terms of
(p - q)^2 / (p + q), in whole numbers.

All of it is relational: texts are exploded into terms and counted, counts are
made dense against the kept vocabulary, dense rows meet themselves on language
and term, and sums and ranks end it.  A term's dense rows are as many as its
language has sources.  Sources meet terms by language and a slice of the term's
hash, so that one large language is spread over SLICES keys; no side is
broadcast by hand.

Defined results: null text, lang and source are empty strings; a group without
terms is compared too, by what smoothing gives it; a language without kept
terms has pairs of value 0; repeated rows count each; an empty table gives no
rows.  A term is counted in a document once however often it stands there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # terms are the matches of its complement; regexp_extract_all copies the text for each match
LEAST = 10  # documents of a term
TOP = 10  # terms reported of a group
SLICES = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, docs rows that hold it), one pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    rows = docs.select(_named("lang"), _named("source"), F.array_remove(F.split(lowered, BETWEEN), "").alias("terms"))
    # a row for each use, and behind those one for each term that the document holds
    both = F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term")
    rows = rows.select("lang", "source", F.size("terms").alias("uses"), both)
    uses = (F.col("at") < F.col("uses")).cast("int")
    return rows.groupBy("lang", "source", "term").agg(F.sum(uses).alias("n"), F.sum(1 - uses).alias("docs"))


def _named(c: str) -> Column:
    return F.coalesce(c, F.lit("")).alias(c)


def share(count: str, total: str, vocabulary: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 vocabulary)); exact, products pass 64 bits."""
    wide = "CAST({} AS DECIMAL(19,0))"
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10,0)) * ({wide.format(count)} + 2)) div ({wide.format(total)} + 2 * {wide.format(vocabulary)})")


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so 64 bits hold the square."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    rows = rows.withColumn("rank", rank)
    rows = rows if top is None else rows.where(F.col("rank") <= top)
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"), "rank")


def divergence(docs: DataFrame, scratch: Scratch, least: int = LEAST, top: int = TOP, slices: int = SLICES) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` holds a group's distance to each other source of its
    language, part `term` the terms that it uses most above its language."""
    counts = scratch.cut(term_counts(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least)
    kept = scratch.cut(kept.select("lang", "term", "all_n", F.pmod(F.xxhash64("term"), F.lit(slices)).alias("slice")), "kept")
    used = scratch.cut(counts.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"), "used")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("all_total"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(_named("lang"), _named("source")).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = scratch.cut(groups.fillna(0, ["total", "v", "all_total"]), "groups")

    spread = groups.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))))
    dense = kept.join(spread, ["lang", "slice"]).join(used, ["lang", "source", "term"], "left").fillna(0, ["n"])
    dense = dense.select("lang", "source", "term", "n", share("n", "total", "v").alias("p"), share("all_n", "all_total", "v").alias("all_p"))
    dense = scratch.cut(dense, "dense")

    one = dense.select("lang", "term", "source", "p")
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = one.join(other, ["lang", "term"]).where(F.col("source") < F.col("item"))  # the distance is that of the other way round
    sums = sums.groupBy("lang", "source", "item").agg(F.sum(distance("p", "q")).alias("value"))
    bare = groups.where("v = 0").select("lang", "source")  # languages without kept terms
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where(F.col("source") < F.col("item")).withColumn("value", F.lit(0).cast("bigint"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = sums.unionAll(bare.select(sums.columns)).select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.*", "value")

    terms = dense.where("n > 0 AND p > all_p").select("lang", "source", F.col("term").alias("item"), distance("p", "all_p").alias("value"))
    return _ranked(pairs, "pair").unionAll(_ranked(terms, "term", top))
