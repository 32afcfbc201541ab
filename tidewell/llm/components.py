"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then v is the smallest node of each component, as u > v."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    seen = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("lowest"))
    return seen.where("ups > 1 OR (ups = 1 AND lowest = 0)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots; root is the smallest node reachable.

    A step only aggregates and joins on a node, so a node with very many
    neighbours is never gathered; each step's edges are written before the next.
    """
    now = scratch.cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star0"
    )
    step = 0
    while not _are_stars(now):
        step += 1
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _nearest(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _nearest(large)
        small = large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = scratch.cut(small.unionAll(near.select("u", F.col("m").alias("v"))).distinct(), f"star{step}")
        scratch.drop(f"star{step - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
