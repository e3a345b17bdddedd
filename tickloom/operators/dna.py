"""Candle DNA: forty scalar metrics of a candle's path, from one shuffle by candle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import CANDLE, in_candle, indexed, ratio, whole_candle


def candle_dna(trades: DataFrame, interval: int) -> DataFrame:
    """A row for each candle. Revisits come in closed form: each run of a price is its first visit or a
    revisit, so revisits = price changes + 1 - distinct prices."""
    w, whole = in_candle(), whole_candle()
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    p = F.col("price_ticks")
    t = indexed(trades, interval).withColumns(
        {
            "d": p - F.lag("price_ticks").over(w),
            "gap": (F.col("us") - F.lag("us").over(w)) / 1000.0,
            "hi": F.max("price_ticks").over(whole),
            "lo": F.min("price_ticks").over(whole),
            "run_hi": F.max("price_ticks").over(running),
            "run_lo": F.min("price_ticks").over(running),
        }
    )
    sign = F.when(F.col("d") != 0, F.signum("d"))
    t = t.withColumn("s", sign).withColumn("last_s", F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    # a level's first trade stands for it: so levels are counted, and the strongest found, by plain sums over trades
    level = Window.partitionBy(*CANDLE, "price_ticks").orderBy("idx")
    every = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({"new_level": F.row_number().over(level) == 1, "level_qty": F.sum("quantity").over(every)})
    t = t.withColumn("most", F.max("level_qty").over(whole))
    by_gap = Window.partitionBy(*CANDLE).orderBy("gap")  # nulls first: the first trade's has place 0
    t = t.withColumn("gap_place", F.row_number().over(by_gap) - 1)
    run = (F.col("idx") == 0) | (F.col("d") != 0)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    qty = lambda c: F.sum(F.when(c, F.col("quantity")).otherwise(0))
    third = (F.col("hi") - F.col("lo")) / 3
    lower = (F.col("hi") > F.col("lo")) & (p <= F.col("lo") + third)
    upper = (F.col("hi") > F.col("lo")) & ~(p <= F.col("lo") + third) & (p >= F.col("hi") - third)
    # the gaps beside the two percentiles; interpolated below as percentiles are
    n_gaps = F.col("n") - 1
    place = {"g50": (n_gaps - 1) * 0.5, "g95": (n_gaps - 1) * 0.95}
    t = t.withColumn("n", F.count("*").over(whole))
    ends = {f"{k}_lo": F.floor(x) for k, x in place.items()} | {f"{k}_hi": F.ceil(x) for k, x in place.items()}
    g = t.groupBy(*CANDLE).agg(
        F.min_by("price_ticks", "idx").alias("open"),
        F.max_by("price_ticks", "idx").alias("close"),
        F.max("price_ticks").alias("high"),
        F.min("price_ticks").alias("low"),
        F.count("*").alias("trades"),
        F.sum("quantity").alias("volume"),
        F.coalesce(F.sum(F.abs("d")), F.lit(0)).alias("path_distance_ticks"),
        one(F.col("d") != 0).alias("price_change_events"),
        one(F.col("d") == 0).alias("unchanged_transitions"),
        one(F.col("s") * F.col("last_s") < 0).alias("reversals"),
        one(F.col("new_level")).alias("unique_prices"),
        F.min(F.when(p == F.col("hi"), F.col("idx"))).alias("hi_idx"),
        F.min(F.when(p == F.col("lo"), F.col("idx"))).alias("lo_idx"),
        F.min(F.when(p == F.col("hi"), F.col("us"))).alias("hi_us"),
        F.min(F.when(p == F.col("lo"), F.col("us"))).alias("lo_us"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        one(run & (p == F.col("hi"))).alias("high_visits"),
        one(run & (p == F.col("lo"))).alias("low_visits"),
        F.min(F.when(F.col("level_qty") == F.col("most"), p)).alias("most_traded_price_ticks"),
        F.sum(p * F.col("quantity")).alias("weighted"),
        F.max("quantity").alias("max_trade_size"),
        qty(F.col("aggressor") == "BUY").alias("buy_aggression_qty"),
        qty(F.col("aggressor") == "SELL").alias("sell_aggression_qty"),
        qty(lower).alias("lower_qty"),
        qty(upper).alias("upper_qty"),
        F.max(F.col("run_hi") - p).alias("max_drawdown_ticks"),
        F.max(p - F.col("run_lo")).alias("max_drawup_ticks"),
        *[F.max(F.when(F.col("gap_place") == 1 + k, F.col("gap"))).alias(name) for name, k in ends.items()],
        F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_intertrade_ms"),
    )
    c = F.col
    part = lambda share: (c("trades") - 2) * share - F.floor((c("trades") - 2) * share)
    between = lambda k, share: F.coalesce(F.when(c(f"{k}_lo") == c(f"{k}_hi"), c(f"{k}_lo")).otherwise((1 - part(share)) * c(f"{k}_lo") + part(share) * c(f"{k}_hi")), F.lit(0.0))
    rng, net, known = c("high") - c("low"), c("close") - c("open"), c("buy_aggression_qty") + c("sell_aggression_qty")
    return g.select(
        *CANDLE,
        rng.alias("range_ticks"),
        "path_distance_ticks",
        net.alias("net_displacement_ticks"),
        ratio(F.abs(net), c("path_distance_ticks")).alias("directional_efficiency"),
        ratio(rng, c("path_distance_ticks")).alias("range_efficiency"),
        ratio(net, rng).alias("body_to_range"),
        ratio(c("close") - c("low"), rng, 0.5).alias("close_location"),
        "reversals",
        (c("reversals") / F.greatest(c("price_change_events") - 1, F.lit(1))).alias("reversal_rate"),
        "price_change_events",
        "unchanged_transitions",
        "unique_prices",
        F.when(rng == 0, "FLAT").when(c("hi_idx") < c("lo_idx"), "HIGH_FIRST").otherwise("LOW_FIRST").alias("high_first"),
        ((c("hi_us") - c("first_us")) / 1000.0).alias("time_to_high_ms"),
        ((c("lo_us") - c("first_us")) / 1000.0).alias("time_to_low_ms"),
        "high_visits",
        "low_visits",
        (c("price_change_events") + 1 - c("unique_prices")).alias("total_revisits"),
        ((c("price_change_events") + 1 - c("unique_prices")) / c("trades")).alias("revisit_rate"),
        "most_traded_price_ticks",
        ratio(c("weighted"), c("volume"), None).alias("vwap_ticks"),
        (c("volume") / c("trades")).alias("mean_trade_size"),
        "max_trade_size",
        "buy_aggression_qty",
        "sell_aggression_qty",
        (c("volume") - known).alias("unknown_aggression_qty"),
        ratio(known, c("volume")).alias("aggressor_coverage"),
        ratio(c("buy_aggression_qty") - c("sell_aggression_qty"), known, None).alias("aggression_imbalance"),
        ratio(c("upper_qty"), c("volume")).alias("upper_third_volume_share"),
        ratio(c("volume") - c("upper_qty") - c("lower_qty"), c("volume")).alias("middle_third_volume_share"),
        ratio(c("lower_qty"), c("volume")).alias("lower_third_volume_share"),
        (c("high") - c("open")).alias("up_excursion_ticks"),
        (c("open") - c("low")).alias("down_excursion_ticks"),
        "max_drawdown_ticks",
        "max_drawup_ticks",
        # the gaps add up to the candle's span
        ratio((c("last_us") - c("first_us")) / 1000.0, c("trades") - 1).alias("avg_intertrade_ms"),
        between("g50", 0.5).alias("median_intertrade_ms"),
        between("g95", 0.95).alias("p95_intertrade_ms"),
        "max_intertrade_ms",
        (c("trades") / float(interval)).alias("trades_per_second"),
        "trades",
        "volume",
    )


PARTS = {
    "dna_path": ["range_ticks", "path_distance_ticks", "net_displacement_ticks", "directional_efficiency", "range_efficiency", "body_to_range", "close_location"],
    "dna_reversals": ["reversals", "reversal_rate", "price_change_events", "unchanged_transitions", "unique_prices"],
    "dna_extremes": ["high_first", "time_to_high_ms", "time_to_low_ms", "up_excursion_ticks", "down_excursion_ticks"],
    "dna_visits": ["high_visits", "low_visits", "total_revisits", "revisit_rate"],
    "dna_poc_vwap": ["most_traded_price_ticks", "vwap_ticks", "mean_trade_size", "max_trade_size", "buy_aggression_qty", "sell_aggression_qty", "unknown_aggression_qty", "aggressor_coverage", "aggression_imbalance"],
    "dna_thirds": ["upper_third_volume_share", "middle_third_volume_share", "lower_third_volume_share"],
    "dna_drawdown": ["max_drawdown_ticks", "max_drawup_ticks"],
    "dna_timing": ["avg_intertrade_ms", "median_intertrade_ms", "p95_intertrade_ms", "max_intertrade_ms", "trades_per_second"],
}
