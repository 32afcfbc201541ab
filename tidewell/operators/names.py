"""Names within an edit distance: candidates by shared q-grams, then the distance itself.

An edit changes at most q of a name's q-grams, so of the q * d + 1 rarest grams
of a name at least one is left in any name within d edits, at most d places
away.  Only these grams (with all occurrences of the last) are join keys; since the
rarest of the whole table come first, names that share a common part do not
meet by it.  A name of q * d grams or fewer has no such gram to rely on: short
names meet, among themselves and with those up to d characters longer, by what
is left of them after at most d deletions, which two names within d edits share.

Where names are made of a few parts (a series and a number, a brand and a size),
every gram is common and so many names are near that candidates by grams are
nearly all pairs.  Such names are cut at one place.  Two names within d edits are
cut, the other at most d characters from there, into parts whose distances add
up to theirs; so near pairs of first parts and of last parts, both few, are put
together to names, and those that the table has are the result.  The
cheapest place is looked for in the table, and without one that leaves few
parts names are not cut.

Names are compared once however many rows carry them: results are pairs of
different names, and `classes` has the rows of each.  Nothing is dropped: the
candidates are a superset and `levenshtein` decides.

Defined results: null names are no names; the empty name is one; names are
compared as they are (normalise before), by code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 2
Q = 2
FEW = 8  # names for each different part, at least, for a cut
LAST_PLACE = 64  # of the places that are looked at


def classes(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(name, first_key, rows): every different name, its smallest key and how many rows have it."""
    named = rows.where(F.col(name).isNotNull())
    return named.groupBy(F.col(name).alias("name")).agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("rows"))


def _grams(names: DataFrame, q: int) -> DataFrame:
    """(name, pos, gram) of every q-gram."""
    places = F.sequence(F.lit(1), F.char_length("name") - q + 1)
    spread = names.where(F.char_length("name") >= q).select("name", F.explode(places).alias("pos"))
    return spread.select("name", "pos", F.substr("name", F.col("pos"), F.lit(q)).alias("gram"))


def _rarest(grams: DataFrame, frequency: DataFrame, n: int) -> DataFrame:
    """(name, pos, gram) of the n rarest grams of each name, and of all places of the last of them."""
    counted = grams.join(frequency, "gram", "left").fillna(0, ["uses"])
    ordered = counted.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("uses", "gram", "pos"))).alias("g"))  # a name's own grams
    last = F.element_at("g", F.least(F.size("g"), F.lit(n)))
    told = lambda x: F.struct(x["uses"], x["gram"])
    kept = ordered.select("name", F.explode(F.filter("g", lambda x: told(x) <= told(last))).alias("x"))
    return kept.select("name", "x.pos", "x.gram")


def _left_after_deletions(name: Column, most: int) -> Column:
    """Every text that at most `most` deletions leave; for short names."""

    def less(x: Column) -> Column:
        places = F.when(F.char_length(x) > 0, F.sequence(F.lit(1), F.char_length(x))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1, F.char_length(x))))

    found = last = F.array(name)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, less)))
        found = F.array_union(found, last)
    return found


def _by_grams(names: DataFrame, queries: DataFrame, most: int, q: int) -> DataFrame:
    """(query, name, distance) of near names that differ; candidates by their rarest grams, or what deletions leave."""
    grams = _grams(names, q)
    frequency = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    n = q * most + 1

    reach = F.explode(F.sequence(F.col("pos") - most, F.col("pos") + most)).alias("pos")
    asked = _rarest(_grams(queries, q), frequency, n).select(F.col("name").alias("query"), "gram", reach)
    by_gram = asked.join(_rarest(grams, frequency, n), ["gram", "pos"]).select("query", "name")

    short = q * most + q - 1  # characters of a name of q * most grams
    left = lambda df, name: df.where(F.char_length("name") <= short + most).select(F.col("name").alias(name), F.explode(_left_after_deletions(F.col("name"), most)).alias("rest"))
    by_rest = left(queries, "query").join(left(names, "name"), "rest").select("query", "name")
    by_rest = by_rest.where(F.least(F.char_length("query"), F.char_length("name")) <= short)

    may = (F.abs(F.char_length("query") - F.char_length("name")) <= most) & (F.col("query") != F.col("name"))
    found = by_gram.where(may).unionAll(by_rest.where(may)).distinct()
    return found.withColumn("distance", F.levenshtein("query", "name", most)).where(F.col("distance") >= 0)


def _place(names: DataFrame) -> int:
    """The place whose cut leaves the fewest different parts; 0 if they are not few."""
    places = F.explode(F.sequence(F.lit(0), F.least(F.char_length("name"), F.lit(LAST_PLACE)))).alias("place")
    parts = [F.approx_count_distinct(x) for x in (F.substr("name", F.lit(1), F.col("place")), F.substr("name", F.col("place") + 1))]
    counts = names.select("name", places).groupBy("place").agg(F.greatest(*parts).alias("parts"), F.count(F.lit(1)).alias("names"))
    found = counts.where(F.col("place") > 0).orderBy(F.col("parts") - F.col("names"), "place").first()  # names that end before count as parts
    return found["place"] if found and found["parts"] * FEW <= found["names"] else 0


def _lengths(names: DataFrame, name: str) -> set[int]:
    return {r[0] for r in names.select(F.char_length(name)).distinct().collect()}


def _by_parts(names: DataFrame, queries: DataFrame, most: int, q: int, place: int) -> DataFrame:
    """(query, name, distance) and the other columns of both: queries are cut at the place, names at those that edits move it to."""
    lengths = _lengths(names, "name")
    longer = {n - m for n in lengths for m in _lengths(queries, "query") if abs(n - m) <= most}
    moved = [m for m in range(-most, most + 1) if any(abs(m) + abs(x - m) <= most for x in longer)] or [0]

    cut = F.sequence(F.least(F.char_length("name"), F.lit(max(0, place + moved[0]))), F.least(F.char_length("name"), F.lit(place + moved[-1])))
    cuts = names.select("name", F.explode(cut).alias("at"))
    asked = queries.withColumns({"first": F.substr("query", F.lit(1), F.lit(place)), "last": F.substr("query", F.lit(place + 1))})

    def near(part: str, parts: Column) -> DataFrame:
        """(part of queries, `other` of names, distance, how much longer this is), equal ones included."""
        mine, others = asked.select(F.col(part).alias("name")).distinct(), cuts.select(parts.alias("name")).distinct()
        same = mine.join(others, "name").select(F.col("name").alias("query"), "name", F.lit(0).alias("distance"))
        found = same.unionAll(_by_grams(others, mine, most, q))
        return found.select(F.col("query").alias(part), F.col("name").alias(f"other_{part}"), F.col("distance").alias(f"{part}_edits"), (F.char_length("name") - F.char_length("query")).alias(f"{part}_longer"))

    first = near("first", F.substr("name", F.lit(1), F.col("at")))
    last = near("last", F.substr("name", F.col("at") + 1)).withColumn("first_edits", F.explode(F.sequence(F.lit(0), most - F.col("last_edits"))))
    sized = asked.withColumn("longer", F.explode(F.array(*map(F.lit, sorted(longer or {0}))))).where((F.char_length("query") + F.col("longer")).isin(sorted(lengths)))
    begun = sized.join(first, "first").withColumn("last_longer", F.col("longer") - F.col("first_longer")).where(F.col("first_edits") + F.abs("last_longer") <= most)
    made = begun.join(last, ["last", "first_edits", "last_longer"]).withColumn("name", F.concat("other_first", "other_last"))
    made = made.where(F.col("name") != F.col("query")).select(*queries.columns, "name", (F.col("first_edits") + F.col("last_edits")).alias("distance"))
    found = made.join(names, "name")
    carried = [c for c in found.columns if c not in ("query", "name", "distance")]
    return found.groupBy("name", "query").agg(F.min("distance").alias("distance"), *[F.first(c).alias(c) for c in carried])


def _near(names: DataFrame, queries: DataFrame, most: int, q: int, place: int | None) -> DataFrame:
    """Pairs of different names (`name`) and different queries (`query`), with the other columns of both."""
    place = _place(names) if place is None else place
    if place:
        return _by_parts(names, queries, most, q, place)
    pairs = _by_grams(names.select("name"), queries.select(F.col("query").alias("name")), most, q)
    return pairs.join(queries, "query").join(names, "name")


def near_names(names: DataFrame, queries: DataFrame, most: int = MOST, q: int = Q, place: int | None = None) -> DataFrame:
    """(query, name, distance): every name within `most` edits of each query name, itself left out.

    Both tables have a column `name`; queries may be any part of the names, or others.  `place` is where
    names are cut, 0 if they are not to be; else the table tells.
    """
    names = names.select("name").where(F.col("name").isNotNull()).distinct()
    queries = queries.select("name").where(F.col("name").isNotNull()).distinct()
    return _near(names, queries.withColumnRenamed("name", "query"), most, q, place).select("query", "name", "distance")


def near_rows(rows: DataFrame, queries: DataFrame, key: str, name: str, most: int = MOST, q: int = Q, place: int | None = None) -> DataFrame:
    """Pairs of near names with the classes behind them: query, name, distance, query_key, name_key, query_rows, name_rows."""
    side = lambda df, s: classes(df, key, name).select(F.col("name").alias(s), F.col("first_key").alias(f"{s}_key"), F.col("rows").alias(f"{s}_rows"))
    found = _near(side(rows, "name"), side(queries, "query"), most, q, place)
    return found.select("query", "name", "distance", "query_key", "name_key", "query_rows", "name_rows")
