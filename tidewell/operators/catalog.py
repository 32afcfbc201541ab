"""Catalog reads; each a filter, order or top-k over catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_key(df: DataFrame, **keys: object) -> DataFrame:
    """SRC-18, RD-1, RD-2, RD-6: rows with these values; the filter is pushed to the scan."""
    for c, v in keys.items():
        df = df.where(F.col(c) == v)
    return df


def active(df: DataFrame, flag: str = "active") -> DataFrame:
    """RD-1, DEL-1: rows in use; nothing is deleted."""
    return df.where(F.col(flag))


def by_price(listings: DataFrame, price: str, *ties: str, **keys: object) -> DataFrame:
    """RD-4: listings of a mall, cheapest first."""
    return by_key(listings, **keys).orderBy(price, *ties)


def chart(history: DataFrame, time: str, *ties: str, **keys: object) -> DataFrame:
    """RD-7: a listing's price history in time."""
    return by_key(history, **keys).orderBy(time, *ties)


def logs_of_jobs(jobs: DataFrame, logs: DataFrame, key: str = "job_id") -> DataFrame:
    """JN-10: the logs of the jobs, each with its job's columns."""
    return logs.join(jobs, key)


def name_prefix(products: DataFrame, column: str, prefix: str) -> DataFrame:
    """RD-3."""
    return products.where(F.startswith(column, F.lit(prefix)))


def lowest_per(rows: DataFrame, key: str, price: str, *ties: str, n: int = 1) -> DataFrame:
    """RD-5: the n cheapest of each key, with `place`."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(price, *ties))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def recent_per(rows: DataFrame, key: str, time: str, *ties: str, n: int = 10) -> DataFrame:
    """RD-8: the n latest of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), *ties))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def recent(rows: DataFrame, time: str, *ties: str, n: int = 10) -> DataFrame:
    """RD-9."""
    return rows.orderBy(F.desc(time), *ties).limit(n)


def lowest_effective(offers: DataFrame, key: str, price: str, fee: str, stock: str, *ties: str) -> DataFrame:
    """RD-10: the cheapest in stock of each key, shipping included."""
    total = F.col(price) + F.coalesce(F.col(fee), F.lit(0))
    offers = offers.where(F.col(stock)).withColumn("effective_price", total)
    best = F.min_by(F.struct(*[c for c in offers.columns if c != key]), F.struct("effective_price", *ties)).alias("r")
    return offers.groupBy(key).agg(best).select(key, "r.*")


def display(listings: DataFrame, products: DataFrame, sellers: DataFrame, malls: DataFrame) -> DataFrame:
    """JN-9: listings with their product's, seller's and mall's names."""
    p = products.select(F.col("canonical_product_id").alias("product_id"), "brand", "gpu_model_id", "vram_gb")
    s = sellers.select(F.col("slug").alias("seller_id"), "seller_name")
    m = malls.select(F.col("code").alias("mall_id"), F.col("display_name").alias("mall_name"))
    return listings.join(p, "product_id", "left").join(s, "seller_id", "left").join(m, "mall_id", "left")


def register(spark, tables: dict[str, DataFrame]) -> None:
    """Temp views, so that plain SQL reads the catalog."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
