"""File exchange: JSON listings, CSV, partitioned raw folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.listing import RAW

CSV_RAW = "source string, original_product_name string, original_price string, seller string, url string, collected_at string"
CSV_NORMALISED = (
    "source string, brand string, gpu_model string, product_name string, part_number string, seller string, price bigint, "
    "shipping_fee int, stock_status string, url string, collected_at string"
)


JSON_RAW = RAW.replace("price string", "price variant")  # a number is not its digits: see text.price_of_variant


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: objects a line; unknown keys are left out, missing ones null; prices keep their JSON kind."""
    return spark.read.schema(JSON_RAW).json(path)


def json_listings(bodies: DataFrame, body: str = "body") -> DataFrame:
    """SRC-26: listings of the JSON bodies of an API's answers, each an array of objects or one object."""
    items = F.from_json(body, f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in JSON_RAW.split(', '))}>>")
    return bodies.select(F.explode(items).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-22, raw layout, as raw listings."""
    rows = spark.read.csv(path, header=True, schema=CSV_RAW)
    return rows.select(
        F.col("source").alias("mall"), F.col("original_product_name").alias("product_name"), F.col("original_price").alias("price"), "seller",
        F.col("url").alias("product_url"), F.col("collected_at").alias("crawled_at"),
    )


def write_csv(valid: DataFrame, path: str) -> None:
    """SRC-22, normalised layout."""
    valid.select(
        F.col("mall_id").alias("source"), "brand", "gpu_model", F.col("normalized_product_name").alias("product_name"),
        F.col("manufacturer_part_number").alias("part_number"), "seller", "price", F.lit(None).cast("int").alias("shipping_fee"),
        F.col("status").alias("stock_status"), F.col("product_url").alias("url"), F.col("crawled_at").cast("string").alias("collected_at"),
    ).write.mode("overwrite").csv(path, header=True)


def write_raw(raw: DataFrame, path: str) -> None:
    """SRC-23: by mall and day of crawl, so that a reprocessing run (SRC-27) prunes folders."""
    day = F.to_date(F.substring(F.col("crawled_at").cast("string"), 1, 10))
    raw.withColumn("crawl_date", day).write.mode("append").partitionBy("mall", "crawl_date").json(path)


def enabled_sources(registry: DataFrame) -> DataFrame:
    """SRC-25: the registry's enabled rows by priority."""
    return registry.where("enabled").orderBy("priority", "source")
