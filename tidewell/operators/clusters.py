"""Offers of any number of sources grouped into products: IDN-7 and IDN-8 beyond two sources, IDN-10 inside a group.

Levels are those of `matching`, strongest first.  At each level the groups so
far that carry one key are joined, and what they join into is one group, unless
it would hold contradictions (new and used, two memory sizes, overclocked and
not): then this level joins none of them, and they are named for review.  Later
levels go on from the groups as they are.

Groups meet by their keys, never pair by pair: each key takes the smallest
group that carries it, each group the smallest of its keys, and groups follow
that until nothing changes.  Every round's labels are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .matching import level_keys, overclocked


def components(members: DataFrame) -> DataFrame:
    """(node, root) for (node, key): nodes that share keys, directly or by others, have the smallest of them as root."""
    members = checkpointed(members.select("node", "key").distinct())
    labels = checkpointed(members.select("node").distinct().withColumn("root", F.col("node")))
    while True:
        of_key = members.join(labels, "node").groupBy("key").agg(F.min("root").alias("least"))
        nearest = members.join(of_key, "key").groupBy("node").agg(F.min("least").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("root").alias("further"))  # what the smallest one has found itself
        new = labels.join(nearest, "node").join(jump, "least").select("node", F.least("root", "further").alias("root"), (F.col("further") < F.col("root")).alias("moved"))
        new = checkpointed(new)
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels


def clusters(offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, reviews): groups is (id, cluster, level), the smallest id of its group and the last level that joined it (0: none);
    reviews is (level, cluster, cluster_before): groups that a level would have joined against a contradiction.

    offers has id, mpn, model_name, brand, gpu_model, vram_gb, name, condition;
    ids are of all sources together and not null.  Rows without any key stay alone.
    """
    keyed = offers.select("id", F.upper(F.coalesce("condition", F.lit("NEW"))).alias("state"), "vram_gb", overclocked(F.col("name")).alias("oc"), F.array(*level_keys()).alias("keys"))
    keyed = checkpointed(keyed)
    now = checkpointed(keyed.select("id", F.col("id").alias("cluster"), F.lit(0).alias("level")))
    reviews = None
    for level in range(1, len(level_keys()) + 1):
        carried = keyed.select("id", F.col("keys")[level - 1].alias("key")).where("key IS NOT NULL").join(now.select("id", "cluster"), "id")
        roots = components(carried.select(F.col("cluster").alias("node"), "key")).toDF("cluster", "root")
        joined = now.join(roots, "cluster", "left").withColumn("root", F.coalesce("root", "cluster"))
        traits = joined.join(keyed, "id").groupBy("root").agg(
            *[(F.coalesce(F.min(c) != F.max(c), F.lit(False))).alias(f"two_{c}") for c in ("state", "vram_gb", "oc")], (F.min("cluster") != F.max("cluster")).alias("several")
        )
        joined = joined.join(traits.where("several").select("root", F.expr("two_state OR two_vram_gb OR two_oc").alias("against")), "root", "left")
        against = F.coalesce("against", F.lit(False))
        came = F.when(F.col("against").isNull() | against, F.col("level")).otherwise(F.lit(level))
        joined = checkpointed(joined.select("id", F.when(against, F.col("cluster")).otherwise(F.col("root")).alias("cluster"), came.alias("level"), F.col("cluster").alias("before"), "root", against.alias("against")))
        review = joined.where("against").select(F.lit(level).alias("level"), F.col("root").alias("cluster"), F.col("before").alias("cluster_before")).distinct()
        reviews = review if reviews is None else reviews.unionAll(review)
        now = joined.select("id", "cluster", "level")
    return now, reviews
