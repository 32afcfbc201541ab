"""One batch from raw listings to the catalog: UPS-4, SRC-3 to SNK-2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import history, joblog, refdata, upsert
from ..sources.tables import Store
from . import listing

PRODUCTS = (
    "canonical_product_id string, brand string, board_partner_id string, gpu_model_id string, normalized_product_name string, vram_gb int, "
    "manufacturer_part_number string, image_url string, active boolean, updated_at timestamp, created_at timestamp"
)
LISTINGS = (
    "listing_id string, product_id string, mall_id string, external_product_id string, seller_id string, raw_product_name string, "
    "normalized_product_name string, current_price bigint, product_url string, availability boolean, status string, image_url string, "
    "crawled_at timestamp, updated_at timestamp"
)
HISTORY = "listing_id string, at_ms bigint, history_id string, seq bigint, price bigint, previous_price bigint, price_change bigint"
LATEST = "listing_id string, stored_at bigint, stored_price bigint"
MALLS = "code string, name string, display_name string, active boolean"
SELLERS = "slug string, seller_name string, normalized_seller_name string, mall_id string, active boolean"


CRAWL_JOBS = "job_id string, mall_id string, status string, keyword string, started_at timestamp, completed_at timestamp, error_message string"
CRAWL_LOGS = "log_id string, job_id string, mall_id string, at bigint, level string, message string, created_at timestamp"


def run_batch(store: Store, raw: DataFrame, masters: dict[str, DataFrame], batch: int, job_id: str, mall_id: str, as_of: Column,
              keyword: str | None = None, on_persist_error: str = "isolate") -> DataFrame:
    """Process, resolve and upsert a batch; returns the processed rows with `persist_error`.

    It reads what batches before `batch` completed, so running it again after a
    failure gives the same tables; if `batch` is complete, nothing is written.
    Of products, listings, malls, sellers and latest prices the parts that the
    batch touches are written; processed rows, price history and logs gain a
    partition.  The job's row is written last and makes all of it visible.

    on_persist_error: 'isolate' leaves a row that cannot be stored out; 'fail'
    stores only what arrived before the first such row.
    """
    processed = listing.process(raw).withColumn("persist_error", F.when(F.col("error").isNull(), listing.persist_error()))
    processed = refdata.resolve(processed, *[masters[k] for k in ("board_partners", "gpu_models", "gpu_vendors", "gpu_families")])
    unresolved = F.coalesce("persist_error", F.when(F.col("error").isNull(), F.col("resolve_error")))
    processed = processed.withColumn("named", F.expr("error IS NULL AND persist_error IS NULL")).withColumn("persist_error", unresolved).drop("resolve_error")
    if store.committed(batch):
        return processed.drop("named")
    if batch <= store.last():
        raise ValueError(f"batch {batch} is not after batch {store.last()}")
    processed = store.append("processed", processed, batch)  # read several times below
    checked = processed.where("named")  # these name their mall, resolved or not
    valid = processed.where("error IS NULL AND persist_error IS NULL")
    if on_persist_error == "fail":
        first = processed.where("persist_error IS NOT NULL").agg(F.min("seq")).first()[0]
        valid = valid if first is None else valid.where(F.col("seq") < first)

    listings = valid.withColumn("listing_id", F.concat_ws("_", "mall_id", "product_id"))
    prices = listings.select("listing_id", "seq", F.unix_millis("crawled_at").alias("at_ms"), "price")
    appended = store.append("price_history", history.replay(prices, latest=store.read("latest_prices", LATEST, batch)), batch)
    malls, sellers = refdata.malls(checked), refdata.sellers(valid)
    changes = (
        ("latest_prices", LATEST, "listing_id", appended, lambda now: history.merge_latest(now, appended)),
        ("products", PRODUCTS, "canonical_product_id", valid, lambda now: upsert.upsert_products(now, valid, as_of)),
        ("listings", LISTINGS, "listing_id", listings, lambda now: upsert.upsert_listings(now, valid, as_of)),
        ("malls", MALLS, "code", malls, lambda now: refdata.insert_absent(now, malls, "code")),
        ("sellers", SELLERS, "slug", sellers, lambda now: refdata.insert_absent(now, sellers, "slug")),
    )
    for name, schema, key, keys, change in changes:
        store.update(name, schema, key, keys, batch, change)
    store.append("crawl_logs", joblog.crawl_logs(processed, job_id, mall_id, keyword, as_of), batch)
    store.append("validation_logs", joblog.validation_logs(processed, "pipeline", as_of), batch)
    store.complete(joblog.finished_job(processed, job_id, mall_id, keyword, as_of), batch, [c[0] for c in changes])
    return processed.drop("named")


def price_history(store: Store) -> DataFrame:
    """The price history of all batches; of rows of one listing and millisecond, that of the latest batch."""
    return history.newest(store.read_all("price_history", HISTORY))
