"""Reconciliation of candles with independent reference candles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import CANDLE, ratio, when_chain, with_start
from .candles import build_candles

FIELDS = ["open", "high", "low", "close"]


def reconcile(trades: DataFrame, references: DataFrame, interval: int) -> DataFrame:
    """A row for each reference candle: status and deltas. Both sides come in one join by candle."""
    c = F.col
    refs = references.filter(c("interval_seconds") == interval)
    own = build_candles(trades, interval).select(*CANDLE, *[c(f"{f}_ticks").alias(f"own_{f}") for f in FIELDS], c("volume").alias("own_volume"), c("trades").alias("own_trades"))
    x = refs.join(own, CANDLE, "left")
    deltas = {f"{f}_delta": c(f"own_{f}") - c(f"{f}_ticks") for f in FIELDS} | {f"{f}_delta": c(f"own_{f}") - c(f) for f in ("volume", "trades")}
    price_ok = sum((F.abs(deltas[f"{f}_delta"]) for f in FIELDS), F.lit(0)) == 0
    rest_ok = (F.coalesce(deltas["volume_delta"], F.lit(0)) == 0) & (F.coalesce(deltas["trades_delta"], F.lit(0)) == 0)
    status = when_chain((c("own_open").isNull(), "NO_DATA"), (price_ok & rest_ok, "EXACT"), (price_ok, "OHLC_MATCH"), default="MISMATCH")
    return x.select(*CANDLE, status.alias("status"), *[d.alias(k) for k, d in deltas.items()])


def reconcile_summary(results: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    g = results.groupBy("symbol").agg(F.count("*").alias("references"), n("EXACT").alias("exact"), n("OHLC_MATCH").alias("ohlc_match"), n("MISMATCH").alias("mismatch"), n("NO_DATA").alias("no_data"))
    comparable = F.col("references") - F.col("no_data")
    return g.withColumns({"ohlc_match_rate": ratio(F.col("exact") + F.col("ohlc_match"), comparable), "exact_rate": ratio(F.col("exact"), comparable)})


def reconcile_available(trades: DataFrame, references: DataFrame, interval: int) -> DataFrame:
    """Only references whose candle has trades: for imports of separate slices."""
    return reconcile(trades, references.join(with_start(trades, interval).select(*CANDLE).distinct(), CANDLE, "left_semi"), interval)


def reconcile_window(trades: DataFrame, references: DataFrame, interval: int) -> DataFrame:
    """References that overlap a symbol's trades. Those at a border that isn't covered are PARTIAL_SOURCE_WINDOW."""
    c = F.col
    window = with_start(trades, interval).groupBy("symbol").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min("start").alias("first_start"), F.max("start").alias("last_start"))
    near = min(5.0, interval * 0.1) * 1e6
    start, end = c("start") * 1_000_000, (c("start") + interval) * 1_000_000
    refs = references.filter(c("interval_seconds") == interval).join(window, "symbol").filter((end > c("first_us")) & (start <= c("last_us")))  # one row a symbol
    whole = when_chain(
        ((c("first_start") < c("start")) & (c("start") < c("last_start")), F.lit(True)),
        ((c("start") == c("first_start")) & (c("start") < c("last_start")), c("first_us") - start <= near),
        (c("start") == c("last_start"), c("last_us") - start >= interval * 1e6 - near),
        default=(start >= c("first_us")) & (end <= c("last_us")),
    )
    refs = refs.withColumn("whole", whole)
    done = reconcile(trades, refs.filter("whole").select(*references.columns), interval)
    left = refs.filter("NOT whole").select(*CANDLE, F.lit("PARTIAL_SOURCE_WINDOW").alias("status"), *[F.lit(None).cast("long").alias(x) for x in done.columns[3:]])
    return done.unionAll(left)
