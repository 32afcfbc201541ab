"""Streams with state: change-only history and windows in event time, against tables and by hand."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import history as table_history
from tidewell.streaming import history, windows


@pytest.fixture
def state_store(spark):
    old = {k: spark.conf.get(k, None) for k in history.STATE_STORE}
    for k, v in history.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def feed(folder, n, rows):
    """File n; a stream takes files by their times, which would tie if they were written at once."""
    path = folder / f"{n:03d}.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(path, (1_790_000_000 + n, 1_790_000_000 + n))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def arrivals_of(seed):
    """Prices of a few listings, one of them hot, at times that do not follow their arrival; gaps and ties included."""
    rng = random.Random(seed)
    rows = []
    for seq in range(400):
        listing = "hot" if rng.random() < 0.5 else f"l{rng.randint(0, 9)}"
        rows.append({"listing_id": listing, "seq": seq, "at_ms": rng.randint(0, 300), "price": rng.choice([100, 100, 110, 120, None])})
    return rows


@pytest.mark.parametrize("stop", [False, True])
def test_stream_equals_replay(spark, state_store, tmp_path, stop):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    rows = arrivals_of(3)

    def go():
        history.write(stream(spark, folder, history.ARRIVALS), out, check).awaitTermination()

    for n in range(5):
        shuffled = rows[80 * n : 80 * (n + 1)]
        random.Random(n).shuffle(shuffled)  # within a micro-batch seq tells the order
        feed(folder, n, shuffled)
        if stop:  # state and output go on from the checkpoint
            go()
    go()
    want = table_history.replay(spark.createDataFrame([tuple(r.values()) for r in rows], history.ARRIVALS))
    got = history.read(spark, out)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_stream_goes_on_from_tables(spark, state_store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = arrivals_of(4)
    frame = lambda some: spark.createDataFrame([tuple(r.values()) for r in some], history.ARRIVALS)
    latest = table_history.latest_stored(table_history.replay(frame(rows[:200])))
    feed(folder, 0, rows[200:])
    history.write(stream(spark, folder, history.ARRIVALS), str(tmp_path / "out"), str(tmp_path / "check"), latest).awaitTermination()
    want = table_history.replay(frame(rows[200:]), latest=latest)
    assert sorted(map(tuple, history.read(spark, str(tmp_path / "out")).select(want.columns).collect())) == sorted(map(tuple, want.collect()))


SEEN = "listing_id string, at timestamp, price bigint, n bigint"


def seen(n, at, price=10, listing="a"):
    return {"listing_id": listing, "at": f"2026-01-01T{at}:00Z", "price": price, "n": n}


BATCHES = [
    [seen(1, "00:10", 5), seen(2, "00:50", 7), seen(3, "01:20", 9)],
    [seen(4, "05:00", 4)],  # from here a delay of 2 hours has closed what ended by 03:00
    [seen(5, "00:20", 1), seen(6, "03:30", 2), seen(7, "04:10", 3)],  # the first comes too late for that
    [seen(8, "23:00", 8)],
]


def windowed(spark, tmp_path, make, late):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for n, rows in enumerate(BATCHES):
        feed(folder, n, rows)
        windows.write(make(stream(spark, folder, SEEN)), out, str(tmp_path / "check"), late).awaitTermination()
    return spark.read.parquet(out)


def shown(df):
    hour = lambda c: F.date_format(c, "HH:mm")
    return sorted(map(tuple, df.select(hour("begins"), hour("ends"), "observations", "min_price", "max_price", "close_price").collect()))


def test_late_rows_are_dropped_after_the_delay(spark, tmp_path):
    got = windowed(spark, tmp_path, lambda s: windows.tumbling(s, ["listing_id"], "at", "price", "n", "1 hour", "2 hours"), "2 hours")
    assert shown(got) == [("00:00", "01:00", 2, 5, 7, 7), ("01:00", "02:00", 1, 9, 9, 9), ("03:00", "04:00", 1, 2, 2, 2), ("04:00", "05:00", 1, 3, 3, 3), ("05:00", "06:00", 1, 4, 4, 4)]


def test_late_rows_are_accepted(spark, tmp_path):
    got = windowed(spark, tmp_path, lambda s: windows.tumbling(s, ["listing_id"], "at", "price", "n", "1 hour", windows.ACCEPT), windows.ACCEPT)
    columns = [c for c in got.columns if c not in ("listing_id", "begins", "batch")]
    newest = got.groupBy("listing_id", "begins").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("begins", "r.*")
    assert shown(newest)[0] == ("00:00", "01:00", 3, 1, 7, 7) and newest.count() == 6
    table = spark.createDataFrame([tuple(r.values()) for b in BATCHES for r in b], "listing_id string, at string, price bigint, n bigint")
    assert shown(newest) == shown(windows.tumbling(table, ["listing_id"], "at", "price", "n", "1 hour", windows.ACCEPT))


def test_sessions_close_after_the_delay(spark, tmp_path):
    got = windowed(spark, tmp_path, lambda s: windows.sessions(s, ["listing_id"], "at", "price", "n", "45 minutes", "2 hours"), "2 hours")
    assert shown(got) == [("00:10", "02:05", 3, 5, 9, 9), ("03:30", "04:55", 2, 2, 3, 3), ("05:00", "05:45", 1, 4, 4, 4)]


def test_sliding_windows(spark):
    rows = spark.createDataFrame([(None, None, 1, 1), ("a", "2026-01-01 00:30:00", 5, 1), ("a", "2026-01-01 01:10:00", 4, 2)], "listing_id string, at string, price bigint, n bigint")
    got = windows.sliding(rows, ["listing_id"], "at", "price", "n", "2 hours", "1 hour", "1 hour")
    assert shown(got) == [("00:00", "02:00", 2, 4, 5, 4), ("01:00", "03:00", 1, 4, 4, 4), ("23:00", "01:00", 1, 5, 5, 5)]
