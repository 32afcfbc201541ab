"""URL filters: explicit rules first, then gradient-boosted trees on lexical features.

A rule ``host/path`` fits its host and all subdomains if the url's path starts
with the rule's; the longest fitting rule decides.  Where none fits, boosted
trees decide from lengths, depths, digit ratios, entropy and parameter counts
of the url, and from statistics learnt from the labelled urls: the log-odds of
the host's name parts, of their four-letter pieces and of its last part (its
suffix).  Host features are taken once for each distinct host.

The trees are trained here, from a table (url, blocked) of which at most
MAX_LABELLED rows are used; the default table is drawn by rule from the word
lists below.  So without labelled urls of one's own the trees hold what those
lists hold, and on names of other words only what shape tells (README).
Everything is DataFrame operations and the JVM's own trees.

Defined results: a null url, and one without ``://``, has an empty host and
path, fits no rule and is judged on its empty features; repeated rows are judged
alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

RULES = (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"),
)
MAX_LABELLED = 20_000
TURNS = 16  # copies of a host's features
BLOCK_FROM = 0.5
PIECE = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words of names that the default labelled urls are made of.
UNWANTED = """casino bet bets poker slots jackpot lottery win winner bonus pills viagra pharmacy meds cheap replica
    adult sex xxx porn cams escort dating spam farm ads ad track tracker tracking click clicks popup banner loan loans
    payday crypto prize free giveaway warez crack torrent keygen malware phish hack""".split()
ORDINARY = """news wiki docs garden music science school city travel river history library recipe recipes sport health
    museum weather forum photo film review local daily green house market research paper open data code project
    university church village theatre radio nature bird stone north south east west""".split()
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo yu zan ter lin mor dal gen sol bru cor thi ans ble".split()
HOST_FEATURES = ("host_length", "host_depth", "host_digits", "host_hyphens", "host_entropy", "part_odds_max", "part_odds_min", "piece_odds_max", "piece_odds_min", "suffix_odds")
URL_FEATURES = ("url_length", "path_depth", "path_length", "digit_ratio", "n_params", "n_escapes", "has_fragment")


def url_parts(url: Column) -> dict[str, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return {"host": F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), "path": F.regexp_extract(url, pattern, 2)}


def rule_columns(rules: Iterable[tuple[str, str]]) -> dict[str, Column]:
    """The longest rule that fits `host` and `path`, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        host, path = text.split("/", 1)
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(f"/{path}"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return {"rule": rule, "ruled": verdict}


def labelled_urls(spark: SparkSession, n: int = 6000, unwanted: Sequence[str] = UNWANTED, ordinary: Sequence[str] = ORDINARY) -> DataFrame:
    """(url, blocked), drawn by rule: names of unwanted words, of ordinary words and of syllables."""

    def pick(words: Iterable[str], salt: int) -> Column:
        words = list(words)
        return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))

    made = F.concat(pick(SYLLABLES, 1), pick(SYLLABLES, 2), pick(["", *SYLLABLES], 3))
    blocked = F.col("id") % 2 == 0
    glue = pick(["-", "-", ""], 4)
    good = F.when(F.col("id") % 3 == 0, F.concat(pick(ordinary, 5), glue, pick(ordinary, 6))).otherwise(
        F.when(F.col("id") % 5 == 0, F.concat(made, glue, pick(ordinary, 7))).otherwise(made)
    )
    other = F.when(F.col("id") % 3 == 0, made).otherwise(F.when(F.col("id") % 7 == 0, pick(["x", "24", "1", "top"], 8)).otherwise(pick(unwanted, 9)))
    bad = F.concat(pick(unwanted, 10), glue, other)
    zone = pick(["example", "site", "", "web", "pages"], 11)
    host = F.concat(
        pick(["", "www.", "m.", "blog.", "shop."], 12), F.when(blocked, bad).otherwise(good),
        F.when(zone == "", "").otherwise(F.concat(F.lit("."), zone)), F.lit("."), pick(["com", "net", "org", "info", "de", "fr", "es"], 13),
    )
    number = F.pmod(F.xxhash64("id", F.lit(14)), F.lit(300_000)).cast("string")
    path = F.concat(F.lit("/"), pick(["en", "de", "fr", "es", "a", "post"], 15), F.lit("/"), number)
    tail = pick(["", "/", ".html", "?page=2&ref=x", "?utm_source=feed", "#top", "?id=7&a=1&b=2"], 16)
    return spark.range(n).select(F.concat(pick(["http://", "https://"], 17), host, path, tail).alias("url"), blocked.alias("blocked"))


def _ratio(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    n = F.greatest(F.length(text), F.lit(1))

    def add(acc: Column, c: Column) -> Column:
        p = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
        return acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0)

    return F.aggregate(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != ""), F.lit(0.0), add)


def _name_parts(host: Column) -> Column:
    """Parts of the host's name at dots and hyphens, without the last label."""
    return F.filter(F.split(F.regexp_replace(host, r"\.?[^.]*$", ""), r"[.-]"), lambda p: p != "")


def _marks(host: Column) -> Column:
    """What statistics are kept of: name parts, their pieces (after '~') and the suffix (after '.')."""
    parts = _name_parts(host)
    pieces = F.flatten(
        F.transform(
            F.filter(parts, lambda p: F.length(p) >= PIECE),
            lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - PIECE + 1), lambda i: F.concat(F.lit("~"), F.substr(p, i, F.lit(PIECE)))),
        )
    )
    return F.array_distinct(F.concat(parts, pieces, F.array(F.concat(F.lit("."), F.substring_index(host, ".", -1)))))


def host_statistics(labelled: DataFrame) -> DataFrame:
    """(mark, odds) of the labelled urls' hosts: log-odds shrunk to 0; MAX_LABELLED bounds its rows."""
    seen = labelled.select(F.explode(_marks(F.col("host"))).alias("mark"), F.col("blocked").cast("double").alias("b"))
    return seen.groupBy("mark").agg(F.log((F.sum("b") + 1) / (F.sum(1 - F.col("b")) + 1)).alias("odds"))


def host_features(hosts: DataFrame, statistics: DataFrame) -> DataFrame:
    """A row for each distinct host."""
    host = F.col("host")
    statistics = F.broadcast(statistics)  # of at most MAX_LABELLED hosts
    odds = hosts.select("host").distinct().select("host", F.explode(_marks(host)).alias("mark")).join(statistics, "mark", "left")
    odd, first = F.coalesce("odds", F.lit(0.0)), F.substring("mark", 1, 1)

    def of(which: Column, best) -> Column:
        return F.coalesce(best(F.when(which, odd)), F.lit(0.0))

    odds = odds.groupBy("host").agg(
        of(~first.isin("~", "."), F.max).alias("part_odds_max"), of(~first.isin("~", "."), F.min).alias("part_odds_min"),
        of(first == "~", F.max).alias("piece_odds_max"), of(first == "~", F.min).alias("piece_odds_min"),
        of(first == ".", F.max).alias("suffix_odds"),
    )
    return odds.select(
        "*", F.length(host).alias("host_length"), F.size(F.split(host, r"\.")).alias("host_depth"), _ratio(host, "[0-9]").alias("host_digits"),
        (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).alias("host_hyphens"), _entropy(host).alias("host_entropy"),
    )


def url_features(url: Column) -> list[Column]:
    url = F.coalesce(url, F.lit(""))
    params = F.size(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != ""))
    count = lambda c: F.length(url) - F.length(F.replace(url, F.lit(c), F.lit("")))
    return [
        F.length(url).alias("url_length"), F.size(F.split("path", "/")).alias("path_depth"), F.length("path").alias("path_length"),
        _ratio(url, "[0-9]").alias("digit_ratio"), params.alias("n_params"), count("%").alias("n_escapes"),
        F.contains(url, F.lit("#")).cast("int").alias("has_fragment"),
    ]


def assembled(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """rows (url, host, path, ...) with the vector `features`."""
    rows = rows.select("*", *url_features(F.col("url")))
    hosts = host_features(rows, statistics).withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))))
    rows = rows.withColumn("_turn", F.pmod(F.xxhash64("url", "path", F.spark_partition_id()), F.lit(TURNS)).cast("int"))
    rows = rows.join(hosts, ["host", "_turn"]).drop("_turn")  # a hot host, or the urls without one, meets its features in so many places
    return VectorAssembler(inputCols=[*HOST_FEATURES, *URL_FEATURES], outputCol="features").transform(rows)


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[GBTClassificationModel, DataFrame]:
    """The trees and the host statistics, of at most max_labelled rows (those with the lowest hash)."""
    labelled = labelled.orderBy(F.xxhash64("url"), "url").limit(max_labelled)
    scratch = Scratch(labelled.sparkSession)
    labelled = scratch.cut(labelled.select("url", "blocked").withColumns(url_parts(F.col("url"))), "labelled")
    # each half's odds come from the other half, so that the trees do not trust names they were counted on
    half = F.pmod(F.xxhash64("host", F.lit(1)), F.lit(2)) == 0
    rows = [assembled(labelled.where(a), host_statistics(labelled.where(b))) for a, b in ((half, ~half), (~half, half))]
    rows = rows[0].unionAll(rows[1]).select("features", F.col("blocked").cast("double").alias("label"))
    model = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.4, maxBins=32, seed=5).fit(rows)
    return model, scratch.cut(host_statistics(labelled), "statistics")


def filter_urls(pages: DataFrame, model: GBTClassificationModel, statistics: DataFrame, carry: Iterable[str] = ("page_id",),
                rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    """Every row (its carried columns) with host, path, rule, score of the trees, verdict."""
    carry = [c for c in carry if c not in ("host", "path", "rule", "score", "verdict")]
    rows = pages.select(F.struct(F.lit(0).alias("_"), *carry).alias("row"), "url").withColumns(url_parts(F.col("url")))
    rows = model.transform(assembled(rows.withColumns(rule_columns(rules)), statistics))
    score = vector_to_array("probability")[1]
    verdict = F.coalesce("ruled", F.when(score >= BLOCK_FROM, "block").otherwise("allow"))
    return rows.select(*[F.col("row")[c].alias(c) for c in carry], "host", "path", "rule", score.alias("score"), verdict.alias("verdict"))
