"""Price observations by windows in event time, for tables and for streams alike.

`late` must be chosen: ACCEPT takes every row whenever it comes (a stream then
gives updated windows, and keeps all of them); a delay such as '2 hours' lets a
stream close a window that far behind the latest time seen, drop what comes for
it later, and give each window once.  A table has no late rows, so both give
the same there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ACCEPT = "accept"


def _aggregated(rows: DataFrame, window: Column, keys: list[str], time: str, price: str, tie: str, late: str) -> DataFrame:
    rows = rows.where(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    if late != ACCEPT:
        rows = rows.withWatermark(time, late)
    last = F.max_by(price, F.struct(time, tie))
    found = rows.groupBy(*keys, window.alias("w")).agg(
        F.count(F.lit(1)).alias("observations"), F.min(price).alias("min_price"), F.max(price).alias("max_price"), last.alias("close_price")
    )
    return found.select(*keys, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "observations", "min_price", "max_price", "close_price")


def tumbling(rows: DataFrame, keys: list[str], time: str, price: str, tie: str, width: str, late: str) -> DataFrame:
    """Windows of `width` side by side: count, least, greatest and last price of each key."""
    return _aggregated(rows, F.window(time, width), keys, time, price, tie, late)


def sliding(rows: DataFrame, keys: list[str], time: str, price: str, tie: str, width: str, slide: str, late: str) -> DataFrame:
    """Windows of `width` that begin every `slide`; a row is in all that hold it."""
    return _aggregated(rows, F.window(time, width, slide), keys, time, price, tie, late)


def sessions(rows: DataFrame, keys: list[str], time: str, price: str, tie: str, gap: str, late: str) -> DataFrame:
    """Runs of rows of a key that are less than `gap` apart; a run ends `gap` after its last row."""
    return _aggregated(rows, F.session_window(time, gap), keys, time, price, tie, late)


def write(windows: DataFrame, path: str, checkpoint: str, late: str) -> StreamingQuery:
    """Every available row into `path`: closed windows, each once; or, if late rows are accepted, each batch's changed windows with its number.

    The newest row of a window is that of its largest batch; a batch that runs
    again writes its own partition anew.
    """
    out = windows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if late != ACCEPT:
        return out.outputMode("append").format("parquet").option("path", path).start()

    def batch(df: DataFrame, number: int) -> None:
        named = df.withColumn("batch", F.lit(number).cast("bigint"))
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return out.outputMode("update").foreachBatch(batch).start()
