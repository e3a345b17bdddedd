"""Candles over streams. Event time must be TIMESTAMP, as watermarks don't take wall-clock times."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import order_key
from ..sources.store import Store


def streaming_candles(trades: DataFrame, interval: int, late: str = "5 minutes") -> DataFrame:
    """Append mode gives a candle once the watermark has passed its end; it is then the batch candle."""
    t = trades.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late).withColumn("us", F.unix_micros("event_time"))
    key = order_key()
    g = t.groupBy("symbol", F.window("event_time", f"{interval} seconds").alias("w")).agg(
        F.min_by("price_ticks", key).alias("open_ticks"), F.max("price_ticks").alias("high_ticks"), F.min("price_ticks").alias("low_ticks"), F.max_by("price_ticks", key).alias("close_ticks"), F.sum("quantity").alias("volume"), F.count("*").alias("trades")
    )
    return g.select("symbol", F.unix_seconds("w.start").alias("start"), "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "trades")


def deduplicated(trades: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Idempotent ingest: an event_key counts once within the watermark."""
    return trades.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late).dropDuplicatesWithinWatermark(["event_key"]).drop("event_time")


def ingest(stream: DataFrame, store: Store, checkpoint: str):
    """Resumable load of a stream of trades into the store. Each micro-batch adds the trades whose event_key isn't stored, so one that is
    run again after a failure adds nothing twice, and a restart goes on where the checkpoint stands."""

    def add(batch: DataFrame, _: int) -> None:
        store.add_trades(batch)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
