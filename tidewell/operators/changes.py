"""What changed between two versions of a table, and a version made from another and its changes.

Each version has one row a key (fold arrivals first, as `upsert.fold` does); one
full outer join on the key tells inserted, removed and changed rows.  Values
are compared null-safely, and a column that only one version has is null in the
other.  Keys may hold nulls, which equal each other.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERTED, CHANGED, REMOVED = "INSERTED", "CHANGED", "REMOVED"


def _sides(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    def side(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
        kinds = {f.name: f.dataType for f in other.schema}
        held = [(F.col(c) if c in df.columns else F.lit(None).cast(kinds[c])).alias(c) for c in columns]
        return df.select(*[F.col(k).alias(f"{name}_{k}") for k in key], F.struct(F.lit(1).alias("there"), *held).alias(name))

    return side(old, new, "old"), side(new, old, "new")


def changes(old: DataFrame, new: DataFrame, key: list[str], ignore: Iterable[str] = ()) -> DataFrame:
    """(*key, change, changed, old, new) of every key whose row is not the same in both.

    `changed` names the columns that differ (those of `ignore` aside), in order;
    `old` and `new` are the other columns of both rows, null where there is none.
    """
    ignore = set(ignore)
    columns = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in key]
    compared = [c for c in columns if c not in ignore]
    left, right = _sides(old, new, key, columns)
    same_key = reduce(lambda a, b: a & b, [F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}")) for k in key])
    both = left.join(right, same_key, "full_outer")
    gone, came = F.col("new").isNull(), F.col("old").isNull()
    differ: list[Column] = [F.when(~F.col("old")[c].eqNullSafe(F.col("new")[c]), F.lit(c)) for c in compared]
    changed = F.array_compact(F.array(*differ)) if differ else F.array().cast("array<string>")
    kind = F.when(came, INSERTED).when(gone, REMOVED).when(F.size(changed) > 0, CHANGED)
    rows = both.withColumn("change", kind).where(F.col("change").isNotNull())
    shown = F.when(F.col("change") == CHANGED, changed).otherwise(F.array().cast("array<string>"))
    values = lambda s: F.when(F.col(s).isNotNull(), F.struct(*[F.col(s)[c].alias(c) for c in columns])).alias(s)
    names = [F.when(came, F.col(f"new_{k}")).otherwise(F.col(f"old_{k}")).alias(k) for k in key]
    return rows.select(*names, "change", shown.alias("changed"), values("old"), values("new"))


def apply_changes(old: DataFrame, feed: DataFrame, key: list[str]) -> DataFrame:
    """The version that `changes` was made against: old with its removed rows gone, its changed rows replaced and the new ones added."""
    same_key = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key])
    untouched = old.alias("o").join(feed.select(*key).alias("f"), same_key, "left_anti")
    added = feed.where(F.col("change") != REMOVED).select(*key, "new.*")
    return untouched.unionByName(added, allowMissingColumns=True)


def summary(feed: DataFrame) -> DataFrame:
    """(change, column, rows): how often each kind of change came, and which columns changed how often."""
    columns = F.explode_outer("changed").alias("column")
    return feed.select("change", columns).groupBy("change", "column").agg(F.count(F.lit(1)).alias("rows"))
