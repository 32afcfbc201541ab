"""Crawl jobs, crawl logs and validation logs as projections of a processed batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_id(*parts: Column) -> Column:
    """ID-3, repeatable: a digest of what the log is about."""
    return F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, 20)


def batch_status(processed: DataFrame) -> DataFrame:
    """AGG-2, AGG-3: one row (items, failures, status); FAILED only if there are items and all failed."""
    counts = processed.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("error").isNotNull()).alias("failures"))
    failed = (F.col("items") > 0) & (F.col("items") == F.col("failures"))
    return counts.withColumn("status", F.when(failed, "FAILED").otherwise("COMPLETED"))


def finished_job(processed: DataFrame, job_id: str, mall_id: str, keyword: str | None, as_of: Column) -> DataFrame:
    """UPS-5: the job's row after the batch."""
    failed = F.col("status") == "FAILED"
    message = F.when(failed, F.concat(F.col("failures").cast("string"), F.lit(" item(s) failed validation")))
    return batch_status(processed).select(
        F.lit(job_id).alias("job_id"), F.lit(mall_id).alias("mall_id"), "status", F.lit(keyword).cast("string").alias("keyword"),
        as_of.alias("started_at"), as_of.alias("completed_at"), message.alias("error_message"),
    )


def latest_jobs(events: DataFrame) -> DataFrame:
    """UPS-5 over appended job events (job_id, seq, status, at): the state of each job."""
    return events.groupBy("job_id").agg(
        F.max_by("status", "seq").alias("status"), F.min("at").alias("started_at"), F.max(F.when(F.col("status") != "RUNNING", F.col("at"))).alias("completed_at")
    )


def crawl_logs(processed: DataFrame, job_id: str, mall_id: str, keyword: str | None, as_of: Column) -> DataFrame:
    """UPS-6: two opening logs, one for each item in order, one closing."""
    product = F.coalesce("product_id", F.lit("unknown"))
    items = processed.select(
        F.col("seq").alias("at"), F.when(F.col("error").isNull(), "INFO").otherwise("WARN").alias("level"),
        F.when(F.col("error").isNull(), F.concat(F.lit("Product processed: "), product))
        .otherwise(F.concat(F.lit("Product validation failed: "), product, F.lit(": "), F.col("error")["message"])).alias("message"),
    )
    status = batch_status(processed)
    failed = F.col("status") == "FAILED"
    start = "Crawl job started" + (f" (keyword={keyword})" if keyword else "")
    opening = status.select(F.explode(F.array(
        F.struct(F.lit(-2).cast("bigint").alias("at"), F.lit("INFO").alias("level"), F.lit(start).alias("message")),
        F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit("INFO").alias("level"), F.concat(F.lit("Processing "), F.col("items").cast("string"), F.lit(" item(s)")).alias("message")),
    )).alias("r")).select("r.*")
    closing = status.select(
        F.lit(2**62).alias("at"), F.when(failed, "ERROR").otherwise("INFO").alias("level"),
        F.when(failed, F.concat(F.lit("Crawl job failed: "), F.col("failures").cast("string"), F.lit(" item(s) failed validation"))).otherwise("Crawl job completed").alias("message"),
    )
    rows = opening.unionByName(items).unionByName(closing)
    return rows.select(
        log_id(F.lit(job_id), F.col("at").cast("string")).alias("log_id"), F.lit(job_id).alias("job_id"), F.lit(mall_id).alias("mall_id"), "at", "level", "message", as_of.alias("created_at"),
    )


def validation_logs(processed: DataFrame, source: str, as_of: Column) -> DataFrame:
    """UPS-8: a FAIL log for each failed row."""
    details = F.struct(
        F.col("error")["message"].alias("message"), F.col("error")["status"].alias("validation_status"), F.col("error")["field"].alias("field"),
        "mall_id", "product_id", F.coalesce("raw_product_name", "product_name").alias("product_name"),
    )
    return processed.where("error IS NOT NULL").select(
        log_id(F.lit(source), F.col("seq").cast("string")).alias("log_id"), F.lit(source).alias("source"), F.lit("FAIL").alias("status"), details.alias("details"), as_of.alias("created_at"),
    )


def kpis(processed: DataFrame) -> DataFrame:
    """AGG-13: shares of valid rows, of rows matched by structure, of repeated listings."""
    listing = F.concat_ws("_", "mall_id", "product_id")
    return processed.agg(
        F.avg(F.col("error").isNull().cast("int")).alias("validation_success"),
        F.avg((F.col("canonical_product_id").isNotNull() & ~F.startswith("canonical_product_id", F.lit("NAME-"))).cast("int")).alias("matching_success"),
        (1 - F.try_divide(F.count_distinct(listing), F.count(F.lit(1)))).alias("duplicate_rate"),
    )
