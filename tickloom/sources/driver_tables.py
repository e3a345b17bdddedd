"""Trades and reference candles made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.candles import build_candles

TICK = 0.01
#: Schemas by path, so that each file's footer is read once.
_SCHEMAS: dict[str, T.StructType] = {}


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as trades of two symbols."""
    path = f"{sf_dir}/events.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    e = spark.read.schema(_SCHEMAS[path]).parquet(path)
    k = F.get_json_object("props", "$.k").cast("long")
    blank = F.col("event_id") % 11 == 0
    return e.select(
        F.concat(F.lit("SYM"), (F.col("user_id") % 2).cast("string")).alias("symbol"),
        "ts",
        F.col("ts").cast("date").alias("session_date"),
        F.round(F.col("value") * 100).cast("long").alias("price_ticks"),
        (k % 20 + 1).alias("quantity"),
        F.col("event_id").cast("string").alias("trade_id"),
        F.when(F.col("event_type").isin("purchase", "click"), "BUY").when(F.col("event_type").isin("view", "error"), "SELL").otherwise("NONE").alias("aggressor"),
        F.lit("driver_events").alias("source"),
        F.when(blank, "").otherwise(F.concat(F.lit("B"), (F.col("user_id") % 7).cast("string"))).alias("buyer_id"),
        F.when(blank, "").otherwise(F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string"))).alias("seller_id"),
        F.col("event_id").alias("sequence_no"),
        F.when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0), "raw_aggressor=RLP").alias("flags"),
    )


def references(spark: SparkSession, sf_dir: str, interval: int = 14_400) -> DataFrame:
    """Candles of the same trades, changed by their bucket's number: every seventh has another volume,
    every eleventh another high, and every thirteenth a start that no candle has."""
    b = F.floor(F.col("start") / interval)
    c = build_candles(trades(spark, sf_dir), interval)
    return c.select(
        "symbol",
        (F.col("start") + F.when(b % 13 == 0, 86_400_000).otherwise(0)).alias("start"),
        F.lit(interval).alias("interval_seconds"),
        "open_ticks",
        (F.col("high_ticks") + F.when(b % 11 == 0, 1).otherwise(0)).alias("high_ticks"),
        "low_ticks",
        "close_ticks",
        (F.col("volume") + F.when(b % 7 == 0, 1).otherwise(0)).alias("volume"),
        F.lit(None).cast("long").alias("trades"),
        F.lit("reference").alias("source"),
    )
