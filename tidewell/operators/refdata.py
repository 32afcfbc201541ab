"""Reference data: seed rows, resolution by joins, insert-if-absent.

Reference tables hold one row a vendor, family, model or partner.  They are
joined without a hint: Spark broadcasts them while their size is under its own
threshold and sorts and merges beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.listing import error, first_failure

SEEDED = "2026-01-01 00:00:00"


def seed(spark: SparkSession, allow_seed: bool = False) -> dict[str, DataFrame]:
    """SRC-20, SRC-21: the four master tables, only if asked for explicitly."""
    if not allow_seed:
        raise PermissionError("seeding needs allow_seed=True")
    rows = {
        "gpu_vendors": ([("NVIDIA", "NVIDIA", True)], "code string, name string, active boolean"),
        "gpu_families": ([("GEFORCE_RTX", "GeForce RTX", "NVIDIA", True)], "code string, name string, vendor_id string, active boolean"),
        "gpu_models": (
            [("rtx_5080", "RTX", "RTX 5080", "NVIDIA", "GEFORCE_RTX", 16, True)],
            "slug string, gpu_series string, gpu_model string, vendor_id string, family_id string, vram_gb int, active boolean",
        ),
        "board_partners": ([("ZOTAC", "ZOTAC", "ZOTAC", True)], "slug string, name string, display_name string, active boolean"),
    }
    return {k: spark.createDataFrame(r, s).withColumn("created_at", F.lit(SEEDED).cast("timestamp")) for k, (r, s) in rows.items()}


def master_count(tables: dict[str, DataFrame]) -> DataFrame:
    """AGG-5."""
    counts = [t.select(F.lit(k).alias("table")) for k, t in tables.items()]
    found = counts[0]
    for c in counts[1:]:
        found = found.unionAll(c)
    return found.groupBy("table").agg(F.count(F.lit(1)).alias("n"))


def resolve(rows: DataFrame, partners: DataFrame, models: DataFrame, vendors: DataFrame, families: DataFrame) -> DataFrame:
    """JN-1..4: rows with `resolve_error`, the first reference that is missing."""
    v, f = vendors.select(F.col("code").alias("_vendor")), families.select(F.col("code").alias("_family"))
    m = models.select(F.col("slug").alias("_model"), "vendor_id", "family_id")
    m = m.join(v, m.vendor_id == v._vendor, "left").join(f, m.family_id == f._family, "left").select("_model", "_vendor", "_family")
    p = partners.select(F.col("slug").alias("_partner"))
    found = rows.join(p, rows.board_partner_id == p._partner, "left").join(m, rows.gpu_model_id == m._model, "left")
    rules = [
        (F.col(f"_{c}").isNull(), error("INVALID", field, f"unknown {c}"))
        for c, field in (("partner", "board_partner_id"), ("model", "gpu_model_id"), ("vendor", "vendor_id"), ("family", "family_id"))
    ]
    return found.withColumn("resolve_error", first_failure(rules)).drop("_partner", "_model", "_vendor", "_family")


def insert_absent(existing: DataFrame, incoming: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """JN-5, JN-6, SET-1: existing and, of each new key, its first incoming row."""
    columns = existing.columns
    first = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), seq).alias("r")).select("r.*")
    return existing.unionByName(first.join(existing.select(key), key, "left_anti").select(columns))


def malls(rows: DataFrame) -> DataFrame:
    return rows.select("seq", F.col("mall_id").alias("code"), F.col("mall_id").alias("name"), F.col("mall").alias("display_name"), F.lit(True).alias("active"))


def sellers(rows: DataFrame) -> DataFrame:
    return rows.select("seq", F.col("seller_id").alias("slug"), F.col("seller").alias("seller_name"), F.col("seller").alias("normalized_seller_name"), "mall_id", F.lit(True).alias("active"))
