"""Simulated data: counterfactual paths of a candle, and a sample of trades. Both are labelled as simulated."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import CANDLE, TRADES

LABEL = "SIMULATED"


def counterfactual_paths(candles: DataFrame, points: int = 64, seed: int = 42) -> DataFrame:
    """One path for each candle: it starts at the open, ends at the close, touches both extremes and leaves them nowhere.

    The extremes' places and their order are drawn from a hash of the candle and the seed. Between these fixed places prices lie on the
    straight line, moved by a hash of the place, by a sixth of the range at most, and held within the range.
    """
    if points < 4:
        raise ValueError("a path has 4 points or more")
    c = F.col
    draw = lambda what: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *CANDLE), F.lit(1 << 30)) / float(1 << 30)
    ok = F.assert_true((c("low_ticks") <= F.least("open_ticks", "close_ticks")) & (c("high_ticks") >= F.greatest("open_ticks", "close_ticks")), F.concat_ws(" ", F.lit("inconsistent OHLC"), "symbol", c("start").cast("string")))
    last = points - 1
    t = candles.select(*CANDLE, "open_ticks", "high_ticks", "low_ticks", "close_ticks", ok.alias("_ok"), F.floor(1 + draw("first") * (last - 2)).cast("int").alias("_a"), (draw("order") < 0.5).alias("_up"))
    t = t.filter("_ok IS NULL").withColumn("_b", (c("_a") + 1 + F.floor(draw("second") * (last - 1 - c("_a")))).cast("int"))
    t = t.withColumns({"_at_a": F.when(c("_up"), c("high_ticks")).otherwise(c("low_ticks")), "_at_b": F.when(c("_up"), c("low_ticks")).otherwise(c("high_ticks"))})
    room = ((c("high_ticks") - c("low_ticks")) / 6).cast("long")

    def price(k: Column) -> Column:
        line = lambda x0, y0, x1, y1: y0 + F.round((y1 - y0) * (k - x0) / (x1 - x0)).cast("long")
        straight = F.when(k <= c("_a"), line(F.lit(0), c("open_ticks"), c("_a"), c("_at_a"))).when(k <= c("_b"), line(c("_a"), c("_at_a"), c("_b"), c("_at_b"))).otherwise(line(c("_b"), c("_at_b"), F.lit(last), c("close_ticks")))
        move = F.pmod(F.xxhash64(F.lit(seed), k, *CANDLE), 2 * room + 1) - room
        fixed = (k == 0) | (k == c("_a")) | (k == c("_b")) | (k == last)
        return F.when(fixed, straight).otherwise(F.least(c("high_ticks"), F.greatest(c("low_ticks"), straight + move)))

    return t.select(*CANDLE, F.transform(F.sequence(F.lit(0), F.lit(last)), price).alias("prices"), F.lit(LABEL).alias("label"))


def path_checks(candles: DataFrame, points: int = 64, seed: int = 42) -> DataFrame:
    """Whether each candle's path keeps its candle's prices."""
    p = F.col("prices")
    at = lambda k: F.element_at(p, k)
    x = counterfactual_paths(candles, points, seed).join(candles.select(*CANDLE, "open_ticks", "high_ticks", "low_ticks", "close_ticks"), CANDLE)
    return x.select(*CANDLE, F.size(p).alias("points"), (at(1) == F.col("open_ticks")).alias("from_open"), (at(-1) == F.col("close_ticks")).alias("to_close"), (F.array_max(p) == F.col("high_ticks")).alias("up_to_high"), (F.array_min(p) == F.col("low_ticks")).alias("down_to_low"), "label")


def sample_trades(spark: SparkSession, symbol: str = "WINLAB06", seed: int = 9_062_026) -> DataFrame:
    """6 sessions x 12 one-minute candles x 40 trades; a fixture of bounded size."""
    rng = random.Random(seed)
    rows, seq = [], 0
    for day in range(6):
        price = 29_000 + rng.randrange(-20, 20)
        for minute in range(12):
            for k in range(40):
                seq += 1
                price += rng.choice((-1, 0, 0, 1))
                ts = datetime(2026, 10, 5 + day, 10, minute) + timedelta(milliseconds=1_450 * k)
                rows.append((symbol, ts, ts.date(), price, rng.randrange(1, 20), str(seq), rng.choice(("BUY", "SELL", "NONE")), "synthetic_sample", f"B{rng.randrange(5)}", f"S{rng.randrange(5)}", seq, None))
    return spark.createDataFrame(rows, TRADES)
