"""Mixing sources to target weights by hierarchical budgeting.

The tree has the levels domain, language and source.  A token budget enters at
the root and is shared among the children of each node by their weights.  A
child takes no more than its subtree holds (tokens times the epochs allowed):
what it cannot take is shared again among its siblings by their weights, and
only what no sibling can take is lost to the parent, whose own share had been
limited in the same way one level up.  A leaf with budget A and T tokens an
epoch takes A div T whole epochs, and of the next one the longest prefix, in
that epoch's seeded order, that holds at most A mod T tokens.

All of it is DataFrame operations.  The shares are exact integers, from two
windows over the children of a node.  The prefix of a leaf of any size is found
by refinement: tokens are summed by the first digits of the order key, the
running sum over those 4096 values finds the one in which the prefix ends, and
the search goes on inside it; rows of a hot leaf never meet in one task.

The order key is md5(seed:epoch:doc_id:md5(text)), so rows equal in both are
taken or left together.  Defined results: null or empty texts hold no tokens
and are taken with their leaf's whole epochs, or while their key is inside the
prefix; null languages and sources are leaves of their own; repeated rows are
each taken; an empty table takes nothing, and a zero budget or zero weights nothing
that holds a token.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SEED = 17
MAX_EPOCHS = 4
LEVELS = ("domain", "language", "origin")
DIGITS = 3  # of the hexadecimal order key at a time
REFINEMENTS = 2
# Weights by name at each level; all other names weigh DEFAULT_WEIGHT.
DEFAULT_WEIGHT = 10
WEIGHTS = {"domain": {"d0": 20}, "language": {"en": 30, "de": 15, "fr": 15}, "origin": {"src0": 20}}
TOKEN = r"[^\x20\x09-\x0D]+"


def default_domain() -> Column:
    """Sources are dealt to four domains by their name."""
    return F.concat(F.lit("d"), F.crc32(F.coalesce(F.col("origin"), F.lit("")).cast("binary")) % 4)


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    found = F.lit(DEFAULT_WEIGHT)
    for name, weight in weights.get(level, {}).items():
        found = F.when(F.col(level) == name, weight).otherwise(found)
    return found.cast("long")


def share(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """nodes with `grant`: the parent's `budget` shared by `weight` within `cap`.

    Ordered by cap / weight, a child is full if the level of the water that
    fills all before it and itself is within the budget; the others divide what
    the full ones leave.
    """
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("cap", "weight", "budget")}
    family = Window.partitionBy(*parent)
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(float("inf"))
    rank = family.orderBy(ratio, F.col(level))
    before, after = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    nodes = nodes.withColumns(
        {"filled": F.coalesce(F.sum(wide["cap"]).over(before), F.lit(0)), "rest": F.sum(wide["weight"]).over(after)}
    )
    full = (F.col("weight") > 0) & (
        wide["cap"] * F.col("rest").cast("decimal(18,0)") + F.col("filled").cast("decimal(19,0)") * wide["weight"].cast("decimal(18,0)")
        <= wide["budget"] * wide["weight"].cast("decimal(18,0)")
    )
    nodes = nodes.withColumn("full", full)
    nodes = nodes.withColumns(
        {"taken": F.sum(F.when(F.col("full"), wide["cap"]).otherwise(0)).over(family),
         "open": F.sum(F.when(F.col("full"), 0).otherwise(wide["weight"])).over(family)}
    )
    part = F.expr("CAST(((budget - taken) * CAST(weight AS DECIMAL(18,0))) div CAST(nullif(open, 0) AS DECIMAL(18,0)) AS BIGINT)")
    grant = F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(part, F.lit(0)))
    return nodes.withColumn("grant", F.least(F.greatest(grant, F.lit(0)), "cap"))


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict, max_epochs: int) -> DataFrame:
    """leaves (LEVELS, tokens) with `grant` tokens each; budget is of the summed `total` tokens."""
    whole = leaves.agg(F.sum("tokens").alias("total")).select(F.lit("").alias("root"), budget.cast("long").alias("budget"))
    nodes = leaves.withColumn("root", F.lit("")).withColumn("cap", F.col("tokens") * max_epochs)
    granted, parent = whole, ["root"]
    for level in LEVELS:
        path = [*parent, level]
        at_level = nodes.groupBy(*path).agg(F.sum("cap").alias("cap"))
        at_level = join_same(at_level, granted, parent)
        at_level = share(at_level.withColumn("weight", weight_of(level, weights)), parent, level)
        granted, parent = at_level.select(*path, F.col("grant").alias("budget")), path
    return granted.select(*LEVELS, F.col("budget").alias("grant"))


def order_key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), "text_md5").cast("binary"))


def join_same(a: DataFrame, b: DataFrame, columns: Iterable[str] = LEVELS, how: str = "inner") -> DataFrame:
    """An equi-join in which null equals null; the columns come from a."""
    right = b.withColumnsRenamed({c: f"{c}_" for c in columns})
    condition = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in columns]
    return a.join(right, condition, how).drop(*(f"{c}_" for c in columns))


def cuts(light: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """plan with `cut`: the largest order key of its `epochs`-th epoch inside `rest` tokens (null: none)."""
    keyed = join_same(light, plan.select(*LEVELS, "epochs")).select(*LEVELS, "n", order_key(F.col("epochs"), seed).alias("key"))
    start = plan.select(*LEVELS, "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("used"))
    running = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    below = []
    for step in range(REFINEMENTS + 1):
        last = step == REFINEMENTS
        width = 32 if last else DIGITS * (step + 1)
        inside = join_same(keyed, start).where(F.col("key").startswith(F.col("prefix")))
        inside = inside.select(*LEVELS, "rest", "used", F.substring("key", 1, width).alias("key"), "n")
        sums = inside.groupBy(*LEVELS, "rest", "used", "key").agg(F.sum("n").alias("n"))
        sums = sums.withColumn("upto", F.col("used") + F.sum("n").over(running))
        fits = F.when(F.col("upto") <= F.col("rest"), F.col("key"))
        below.append(sums.groupBy(*LEVELS).agg(F.max(fits).alias("key")).where("key is not null"))
        if not last:
            over = sums.where("upto > rest")
            here = F.struct("rest", F.col("key").alias("prefix"), (F.col("upto") - F.col("n")).alias("used"))
            start = over.groupBy(*LEVELS).agg(F.min_by(here, "key").alias("s")).select(*LEVELS, "s.*")
    union = below[0]
    for b in below[1:]:
        union = union.unionAll(b)
    # a prefix of a key stands for all keys that start with it
    union = union.groupBy(*LEVELS).agg(F.max(F.rpad("key", 32, "g")).alias("cut"))
    return join_same(plan, union, how="left").select(*LEVELS, "epochs", "cut")


def mix(docs: DataFrame, scratch: Scratch, carry: Iterable[str] = ("doc_id",), budget: Column | None = None,
        domain: Column | None = None, weights: dict[str, dict[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED) -> DataFrame:
    """A row (its carried columns, the leaf, tokens, epoch) for each time that a row of docs is taken.

    budget: of the mixture in tokens; a column over `total`, the tokens of docs (default: total).
    domain: a column over `origin` (the source) and `language`.
    """
    carry = [c for c in carry if c not in (*LEVELS, "tokens", "epoch")]
    budget = F.col("total") if budget is None else budget
    domain = default_domain() if domain is None else domain
    rows = docs.select(
        F.struct(F.lit(0).alias("_"), *carry).alias("row"), F.col("doc_id").alias("id"), F.col("lang").alias("language"),
        F.col("source").alias("origin"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumns({"domain": domain, "text_md5": F.md5(F.col("text").cast("binary"))})
    light = rows.select("id", *LEVELS, "text_md5", F.regexp_count("text", F.lit(TOKEN)).cast("long").alias("n"))
    light = scratch.cut(light, "light")
    leaves = light.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    granted = leaf_budgets(leaves, budget, weights, max_epochs)
    plan = join_same(leaves, granted)
    per = F.greatest("tokens", F.lit(1))
    plan = plan.select(*LEVELS, F.expr("grant div greatest(tokens, 1)").alias("epochs"), (F.col("grant") % per).alias("rest"))
    plan = scratch.cut(cuts(light, scratch.cut(plan, "plan"), seed), "cuts")

    source = rows if carry != ["doc_id"] else light.select(F.struct(F.col("id").alias("doc_id")).alias("row"), "*")
    tokens = F.regexp_count("text", F.lit(TOKEN)).cast("long") if carry != ["doc_id"] else F.col("n")
    found = join_same(source, plan)
    inside = F.col("cut").isNotNull() & (order_key(F.col("epochs"), seed) < F.col("cut"))
    inside |= order_key(F.col("epochs"), seed) == F.col("cut")
    taken = F.col("epochs") + F.when(inside, 1).otherwise(0)
    found = found.withColumn("taken", taken).where("taken > 0")
    return found.select(
        *[F.col("row")[c].alias(c) for c in carry], *LEVELS, tokens.alias("tokens"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)).alias("epoch"),
    )
