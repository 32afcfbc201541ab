"""Streams of listings: a micro-batch is a batch, and one writer leaves no races."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import run_batch
from ..sources.files import JSON_RAW
from ..sources.tables import Store


def listing_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(JSON_RAW).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(stream: DataFrame, store: Store, masters: dict[str, DataFrame], checkpoint: str, mall_id: str) -> StreamingQuery:
    """Every available listing into the catalog; a micro-batch that is run again is the same batch of the store, and is stored once."""

    def batch(df: DataFrame, number: int) -> None:
        run_batch(store, df, masters, number + 1, f"{mall_id}_{number}", mall_id, F.current_timestamp())

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
