"""Streams against batches: waves by state and timers, live candles with late trades."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import T0, trades
from tickloom.operators.candles import build_candles
from tickloom.operators.waves import WaveRules, open_waves, waves
from tickloom.schema import TRADES
from tickloom.sources.store import Store
from tickloom.streaming import live as L
from tickloom.streaming.waves import OPEN, streaming_waves


def feed(spark, folder, t, order, size):
    """Files of ``size`` trades, in this order of their sequence numbers; one is a micro-batch."""
    rows = {r.sequence_no: r for r in t.collect()}
    for k in range(0, len(order), size):
        part = spark.createDataFrame([rows[i] for i in order[k : k + size]], TRADES).coalesce(1)
        part.write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(TRADES).option("maxFilesPerTrigger", 1).parquet(str(folder))


RULES = WaveRules(window=5)


def test_waves_over_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # the last candle's trades only move the watermark on; waves are open at the ends of others
    t = trades(spark, [(k, 100 + k % 5, 1 + k % 7, "BUY" if k % 80 < 45 else "NONE", "A") for k in range(240)] + [(900, 100, 1, "NONE", "A")])
    order = list(range(1, 242))
    rng = random.Random(2)
    for k in range(0, 240, 20):  # out of order within the lateness that is waited for
        part = order[k : k + 20]
        rng.shuffle(part)
        order[k : k + 20] = part
    run = lambda: streaming_waves(stream(spark, tmp_path / "in"), 60, RULES, "30 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    feed(spark, tmp_path / "in", t, order[:120], 40)
    run()
    feed(spark, tmp_path / "in", t, order[120:], 61)
    run()
    names = ["symbol", "start", "wave", "side", "start_idx", "peak_qty"]
    got = spark.read.parquet(str(tmp_path / "out"))
    ended = {tuple(r) for r in got.filter("status IS NULL").select(*names, "end_idx", "termination").collect()}
    assert ended and ended == {tuple(r) for r in waves(t, 60, RULES).select(*names, "end_idx", "termination").collect()}
    held = {tuple(r) for r in got.filter(F.col("status") == OPEN).select(*names, "last_idx").collect()}
    assert held and held == {tuple(r) for r in open_waves(t, 60, RULES).select(*names, "last_idx").collect()}


def candles(df):
    return sorted(map(tuple, df.select("symbol", "start", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "trades").collect()))


@pytest.mark.parametrize("order", ["sorted", "shuffled", "reversed"])
def test_late_streams_end_with_the_batch_candles(spark, tmp_path, order):
    t = trades(spark, [(k * 20, 100 + k * k % 11, 1 + k % 3, "BUY", "A") for k in range(90)], T0 + timedelta(hours=13, minutes=45))  # over midnight
    places = list(range(1, 91))
    if order == "shuffled":
        random.Random(8).shuffle(places)
    elif order == "reversed":
        places.reverse()
    store, seen = Store(spark, str(tmp_path / "db")), []
    run = lambda: L.live(stream(spark, tmp_path / "in"), store, str(tmp_path / "cp"), 300, 60, lambda b, n: seen.append(n)).awaitTermination()
    feed(spark, tmp_path / "in", t, places[:45], 23)
    run()
    feed(spark, tmp_path / "in", t, places[45:], 45)
    run()
    late = sum(n["late"] for n in seen)
    assert sum(n["received"] for n in seen) == 90 and (late == 0) == (order == "sorted")
    assert L.absorb(store, 300)["late"] == late and L.absorb(store, 300) == {"late": 0, "days": 0}
    L.close(store, 300)
    assert store.read("trades").count() == 90
    assert candles(store.read("live_candles")) == candles(build_candles(t, 300))


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    t = trades(spark, [(k * 30, 100 + k, 1, "BUY", "A") for k in range(40)])
    early, rest = t.filter("sequence_no NOT IN (3, 4) AND sequence_no <= 30"), t.filter("sequence_no IN (3, 4) OR sequence_no > 30")
    assert L._take(store, early, 0, 300, 0) == {"received": 28, "late": 0, "candles": 2}
    first = L._take(store, rest, 1, 300, 0)
    assert first["late"] == 2
    held = candles(store.read("live_candles"))
    again = L._take(store, rest, 1, 300, 0)
    assert again["late"] == 2 and again["candles"] == 0 and candles(store.read("live_candles")) == held
    assert store.read("quarantine").count() == 2 and store.read("trades").count() == 38
