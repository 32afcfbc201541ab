"""Merge upserts as pure functions (existing, incoming) -> new snapshot.

Incoming rows of one key are folded by arrival (`seq`): of each column the last
value, or the last that is not null where absent values must not erase.  The
fold is an aggregation, pre-summed in the tasks, so a key with very many rows
in a batch is no hot spot; the merge is one full outer join on the key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last(c: str | Column, seq: str = "seq", keep: bool = False) -> Column:
    """The value that arrived last; with `keep`, the last that is not null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.max_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), F.col(seq))) if keep else F.max_by(c, seq)


def fold(incoming: DataFrame, key: list[str], columns: Iterable[str], keep: Iterable[str] = (), seq: str = "seq") -> DataFrame:
    keep = set(keep)
    return incoming.groupBy(*key).agg(*[last(c, seq, c in keep).alias(c) for c in columns])


def merge(existing: DataFrame, incoming: DataFrame, key: list[str], keep: Iterable[str] | None = None) -> DataFrame:
    """UPS-1: incoming columns replace; those in `keep` (default all) only where not null; others stay."""
    new = [c for c in incoming.columns if c not in key]
    keep = set(new if keep is None else keep)
    right = incoming.select(*key, *[F.col(c).alias(f"_{c}") for c in new], F.lit(True).alias("_in"))
    joined = existing.join(right, key, "full_outer")

    def merged(c: str) -> Column:
        old = F.col(c) if c in existing.columns else F.lit(None)
        if c not in new:
            return old.alias(c)
        return (F.coalesce(f"_{c}", old) if c in keep else F.when(F.col("_in"), F.col(f"_{c}")).otherwise(old)).alias(c)

    columns = [c for c in existing.columns if c not in key] + [c for c in new if c not in existing.columns]
    return joined.select(*key, *map(merged, columns))


def upsert_products(existing: DataFrame, valid: DataFrame, as_of: Column) -> DataFrame:
    """UPS-2: active again, created once; part number and image stay if none comes."""
    rows = valid.select(
        "seq", "canonical_product_id", "brand", "board_partner_id", "gpu_model_id", "normalized_product_name", "vram_gb",
        "manufacturer_part_number", F.nullif("image_url", F.lit("")).alias("image_url"),
    )
    kept = ("manufacturer_part_number", "image_url")
    new = fold(rows, ["canonical_product_id"], [c for c in rows.columns if c not in ("seq", "canonical_product_id")], kept)
    new = new.withColumns({"active": F.lit(True), "updated_at": as_of})
    first = existing.select("canonical_product_id", F.col("created_at"))
    merged = merge(existing.drop("created_at"), new, ["canonical_product_id"], kept)
    return merged.join(first, "canonical_product_id", "left").withColumn("created_at", F.coalesce("created_at", as_of))


def upsert_listings(existing: DataFrame, valid: DataFrame, as_of: Column) -> DataFrame:
    """UPS-3: the last arrival wins, late or not."""
    rows = valid.select(
        "seq", F.concat_ws("_", "mall_id", "product_id").alias("listing_id"), F.col("canonical_product_id").alias("product_id"), "mall_id",
        F.col("product_id").alias("external_product_id"), "seller_id", "raw_product_name", "normalized_product_name",
        F.col("price").alias("current_price"), "product_url", "availability", "status", F.nullif("image_url", F.lit("")).alias("image_url"), "crawled_at",
    )
    kept = ("image_url", "crawled_at")
    new = fold(rows, ["listing_id"], [c for c in rows.columns if c not in ("seq", "listing_id")], kept)
    return merge(existing, new.withColumn("updated_at", as_of), ["listing_id"], kept)
