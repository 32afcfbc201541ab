"""Change-only price history of a stream: the last price of each listing is kept state.

The rule is that of `operators.history.replay`: a price is compared with that of
the latest stored time of its listing, whenever it comes, and a row is stored if
they differ.  What the rule needs of a listing, one time and one price, lives in
the state store, so a micro-batch costs its own rows and not the history.
Within a micro-batch rows go by `seq`, their number of arrival; a micro-batch
must not hold rows that arrived after those of a later one.

The state store must be RocksDB's (`STATE_STORE`), as Spark asks of this operator.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ARRIVALS = "listing_id string, seq bigint, at_ms bigint, price bigint"
APPENDED = "listing_id string, seq bigint, at_ms bigint, price bigint, previous_price bigint, price_change bigint"
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class ChangeOnly(StatefulProcessor):
    """WIN-1 of one listing: state is the latest stored time and its price."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "stored_at bigint, stored_price bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        known = self.latest.get() if self.latest.exists() else None
        at, price = known if known else (None, None)
        for r in sorted(rows, key=lambda r: r.seq):  # of one micro-batch and listing
            if price is not None and r.price == price:
                continue
            yield Row(listing_id=key[0], seq=r.seq, at_ms=r.at_ms, price=r.price, previous_price=price, price_change=None if price is None else r.price - price)
            if at is None or r.at_ms >= at:
                at, price = r.at_ms, r.price
        if at is not None:
            self.latest.update((at, price))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:
        self.latest.update((initialState.stored_at, initialState.stored_price))

    def close(self) -> None:
        pass


def appended(arrivals: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """The stream of rows that arrivals append to the history; `latest` (listing_id, stored_at, stored_price) is what tables held before.

    Rows without a listing, time or price are no observations.  Of several rows
    of one listing and millisecond the one with the largest seq is in force.
    """
    rows = arrivals.where("listing_id IS NOT NULL AND price IS NOT NULL AND at_ms IS NOT NULL").select("listing_id", "seq", "at_ms", F.col("price").cast("bigint").alias("price"))
    initial = latest.groupBy("listing_id") if latest is not None else None
    return rows.groupBy("listing_id").transformWithState(ChangeOnly(), APPENDED, "append", "none", initial)


def write(arrivals: DataFrame, path: str, checkpoint: str, latest: DataFrame | None = None) -> StreamingQuery:
    """Every available arrival; each appended row is in `path` once, whatever was run again."""
    out = appended(arrivals, latest).writeStream.format("parquet").outputMode("append")
    return out.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The history written so far; of one listing and millisecond the row that arrived last."""
    rows = spark.read.schema(APPENDED).parquet(path)
    last = F.max_by(F.struct("seq", "price", "previous_price", "price_change"), "seq").alias("r")
    return rows.groupBy("listing_id", "at_ms").agg(last).select("listing_id", "at_ms", F.col("at_ms").cast("string").alias("history_id"), "r.*")
