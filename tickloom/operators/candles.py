"""Candles, their roll-up, running timelines, volume profiles and overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import CANDLE, in_candle, indexed, order_key, ratio, with_start


def build_candles(trades: DataFrame, interval: int, *more: Column) -> DataFrame:
    """OHLCV by (symbol, start), and ``more`` aggregates of the same pass. First and last are ordered aggregates, so only
    partly aggregated candles are shuffled, not trades."""
    key = order_key(trades)
    return with_start(trades, interval).groupBy(*CANDLE).agg(
        F.min_by("price_ticks", key).alias("open_ticks"),
        F.max("price_ticks").alias("high_ticks"),
        F.min("price_ticks").alias("low_ticks"),
        F.max_by("price_ticks", key).alias("close_ticks"),
        F.sum("quantity").alias("volume"),
        F.count("*").alias("trades"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        *more,
    )


def roll_up(candles: DataFrame, interval: int) -> DataFrame:
    """Longer candles from shorter ones whose interval divides theirs."""
    return candles.withColumn("child", F.col("start")).withColumn("start", (F.floor(F.col("start") / interval) * interval).cast("long")).groupBy(*CANDLE).agg(
        F.min_by("open_ticks", "child").alias("open_ticks"),
        F.max("high_ticks").alias("high_ticks"),
        F.min("low_ticks").alias("low_ticks"),
        F.max_by("close_ticks", "child").alias("close_ticks"),
        F.sum("volume").alias("volume"),
        F.sum("trades").alias("trades"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    )


def multi_interval(trades: DataFrame, intervals: list[int]) -> DataFrame:
    """Candles of several intervals from one pass over the trades, by roll-up from the shortest."""
    base = build_candles(trades, intervals[0])
    out = base.withColumn("interval_seconds", F.lit(intervals[0]))
    for n in intervals[1:]:
        if n % intervals[0]:
            raise ValueError("each interval must be a multiple of the first")
        out = out.unionByName(roll_up(base, n).withColumn("interval_seconds", F.lit(n)))
    return out


def timeline(trades: DataFrame, interval: int) -> DataFrame:
    """The candle as it looked after each of its trades."""
    w = in_candle().rowsBetween(Window.unboundedPreceding, 0)
    side = lambda s: F.sum(F.when(F.col("aggressor") == s, F.col("quantity")).otherwise(0)).over(w)
    out = indexed(trades, interval).withColumns(
        {
            "open_ticks": F.first("price_ticks").over(w),
            "high_ticks": F.max("price_ticks").over(w),
            "low_ticks": F.min("price_ticks").over(w),
            "volume": F.sum("quantity").over(w),
            "buy": side("BUY"),
            "sell": side("SELL"),
        }
    )
    known = F.col("buy") + F.col("sell")
    imbalance = ratio(F.col("buy") - F.col("sell"), known, None)
    return out.select(*CANDLE, (F.col("idx") + 1).alias("trade_number"), "us", "open_ticks", "high_ticks", "low_ticks", F.col("price_ticks").alias("close_ticks"), "volume", "buy", "sell", imbalance.alias("imbalance"))


def volume_profile(trades: DataFrame, interval: int) -> DataFrame:
    q = lambda s: F.sum(F.when(F.col("aggressor") == s, F.col("quantity")).otherwise(0))
    out = with_start(trades, interval).groupBy(*CANDLE, "price_ticks").agg(F.sum("quantity").alias("volume"), q("BUY").alias("buy"), q("SELL").alias("sell"), q("NONE").alias("unknown"), F.count("*").alias("trades"))
    return out.withColumn("delta", F.col("buy") - F.col("sell"))


def symbol_overview(trades: DataFrame) -> DataFrame:
    t = with_start(trades, 60)
    return t.groupBy("symbol").agg(F.count("*").alias("trades"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def session_overview(trades: DataFrame) -> DataFrame:
    t = with_start(trades, 60)
    return t.groupBy("symbol", "session_date").agg(F.count("*").alias("trades"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.sum("quantity").alias("volume"))


def reference_overview(references: DataFrame) -> DataFrame:
    return references.groupBy("symbol", "interval_seconds").agg(F.count("*").alias("candles"), F.min("start").alias("first_start"), F.max("start").alias("last_start"), F.min("source").alias("source"))


def store_stats(trades: DataFrame, references: DataFrame) -> DataFrame:
    a = trades.agg(F.count("*").alias("trades"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("symbol", "session_date").alias("sessions"))
    return a.crossJoin(F.broadcast(references.agg(F.count("*").alias("reference_candles"))))  # one row each


def instrument_overview(instruments: DataFrame, trades: DataFrame) -> DataFrame:
    """Every instrument with its trades, if it has any."""
    g = symbol_overview(trades)
    return instruments.join(g, "symbol", "left").withColumn("trades", F.coalesce("trades", F.lit(0)))


def library_overview(trades: DataFrame, quality: DataFrame) -> DataFrame:
    """Every session with its quality, in one join."""
    q = quality.select("symbol", "session_date", "status", "score", "eligible")
    return session_overview(trades).join(q, ["symbol", "session_date"], "left")


def slice_trades(trades: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Trades in the half-open interval [start, end)."""
    return with_start(trades, 60).filter((F.col("us") >= start_us) & (F.col("us") < end_us))
