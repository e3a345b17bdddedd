"""The research index (shape, volatility, regimes, opening gaps, quality) and similarity search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import CANDLE, indexed_once, ratio, when_chain
from .candles import build_candles
from .dna import candle_dna
from .quality import SCHEDULES, SESSION, Schedule, session_quality


def with_session(candles: DataFrame) -> DataFrame:
    """``session_date`` from the wall clock of ``start``."""
    return candles.withColumn("session_date", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("start") / 86_400).cast("int")))


def shape(candles: DataFrame) -> DataFrame:
    c = F.col
    span, body = c("high_ticks") - c("low_ticks"), c("close_ticks") - c("open_ticks")
    return candles.withColumns(
        {
            "direction": F.when((span <= 0) | (body == 0), "DOJI").when(body > 0, "BULLISH").otherwise("BEARISH"),
            "body_share": ratio(F.abs(body), span),
            "upper_wick_share": ratio(c("high_ticks") - F.greatest("open_ticks", "close_ticks"), span),
            "lower_wick_share": ratio(F.least("open_ticks", "close_ticks") - c("low_ticks"), span),
        }
    )


def regime(net: Column, path: Column, span: Column) -> dict[str, Column]:
    efficiency, share = ratio(F.abs(net), path), ratio(F.abs(net), span)
    trend = (share >= 0.55) & (efficiency >= 0.25)
    label = when_chain((span == 0, "RANGE"), (trend & (net > 0), "TREND_UP"), (trend, "TREND_DOWN"), ((share <= 0.28) | (efficiency <= 0.12), "RANGE"), default="MIXED")
    return {"regime": label, "efficiency": efficiency, "net_to_range": share}


def _frame_regime(w, frame) -> dict[str, Column]:
    """The regime of the candles in a frame. A path starts at the frame's first open: of its first candle, the
    way from the close before is taken out and that from its own open put in."""
    c = F.col
    net = c("close_ticks") - F.first("open_ticks").over(frame)
    path = F.sum("step").over(frame) - F.first("step").over(frame) + F.abs(F.first("close_ticks").over(frame) - F.first("open_ticks").over(frame))
    return regime(net, path, F.max("high_ticks").over(frame) - F.min("low_ticks").over(frame))


def research_index(trades: DataFrame, interval: int, schedules: list[Schedule] = SCHEDULES) -> DataFrame:
    c = F.col
    trades = indexed_once(trades, interval)  # candles and DNA come from one shuffle of the trades
    base = with_session(shape(build_candles(trades, interval).drop("first_us", "last_us")))
    s = Window.partitionBy(*SESSION).orderBy("start")
    whole = Window.partitionBy(*SESSION)
    base = base.withColumn("step", F.coalesce(F.abs(c("close_ticks") - F.lag("close_ticks").over(s)), F.lit(0)))
    frames = {"session": s.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), "short": s.rowsBetween(-4, 0), "medium": s.rowsBetween(-14, 0), "to_date": s.rowsBetween(Window.unboundedPreceding, 0)}
    add = {}
    for name, frame in frames.items():
        found = _frame_regime(s, frame)
        add["session_regime" if name == "session" else f"regime_{name}"] = found["regime"]
        if name == "session":
            last = F.last("close_ticks").over(frame)
            net = last - F.first("open_ticks").over(frame)
            path = F.sum("step").over(frame) - F.first("step").over(frame) + F.abs(F.first("close_ticks").over(frame) - F.first("open_ticks").over(frame))
            found = regime(net, path, F.max("high_ticks").over(frame) - F.min("low_ticks").over(frame))
            add |= {"session_regime": found["regime"], "session_directional_efficiency": found["efficiency"], "session_net_to_range": found["net_to_range"]}
    span = c("high_ticks") - c("low_ticks")
    usual = F.median(F.when(span > 0, span)).over(whole)
    volatility = F.coalesce(span / usual, F.when(span == 0, 1.0).otherwise(99.0))
    base = base.withColumns(add | {"volatility_ratio": volatility})
    bucket = when_chain((c("volatility_ratio") < 0.65, "LOW"), (c("volatility_ratio") < 1.35, "NORMAL"), (c("volatility_ratio") < 2.25, "HIGH"), default="EXTREME")
    base = base.withColumn("volatility_bucket", bucket)
    gaps = opening_gaps(base)
    quality = session_quality(trades, schedules).select(*SESSION, F.col("status").alias("quality_status"), F.col("score").alias("quality_score"), "eligible")
    dna = candle_dna(trades, interval).drop("trades", "volume")
    return base.drop("step").join(dna, CANDLE).join(gaps, SESSION).join(quality, SESSION)


def opening_gaps(candles: DataFrame) -> DataFrame:
    """Each session's first open against the close and range of the symbol's session before."""
    c = F.col
    g = candles.groupBy(*SESSION).agg(F.min_by("open_ticks", "start").alias("open"), F.max_by("close_ticks", "start").alias("close"), (F.max("high_ticks") - F.min("low_ticks")).alias("span"))
    w = Window.partitionBy("symbol").orderBy("session_date")  # one row a session
    g = g.withColumns({"opening_gap_ticks": c("open") - F.lag("close").over(w), "before": F.lag("span").over(w)})
    g = g.withColumn("opening_gap_ratio", F.when(c("before") != 0, c("opening_gap_ticks") / c("before")).when(c("opening_gap_ticks") == 0, 0.0))
    size = F.abs("opening_gap_ratio")
    name = F.when(size < 0.25, "SMALL").when(size < 0.50, "MEDIUM").otherwise("LARGE")
    bucket = when_chain(
        (c("opening_gap_ticks").isNull() | c("opening_gap_ratio").isNull(), "NO_PREVIOUS_SESSION"),
        ((size < 0.10) | (c("opening_gap_ticks") == 0), "NONE"),
        default=F.concat(name, F.when(c("opening_gap_ticks") > 0, "_UP").otherwise("_DOWN")),
    )
    return g.select(*SESSION, "opening_gap_ticks", "opening_gap_ratio", bucket.alias("opening_gap_bucket"))


def log_distance(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.least(F.abs(F.log((F.greatest(a.cast("double"), zero) + 1) / (F.greatest(b.cast("double"), zero) + 1))) / 2, F.lit(1.0))


def _parts(kind: str) -> tuple[list[tuple[Column, float]], float | None]:
    """((distance, weight) of each feature, weight of the aggression); the target's columns start with t_."""
    gap = lambda x: F.abs(F.col(f"t_{x}") - F.col(x))
    logs = lambda x: log_distance(F.col(f"t_{x}"), F.col(x))
    other = lambda x: F.when(F.col(f"t_{x}") == F.col(x), 0.0).otherwise(1.0)
    few = lambda x: F.least(gap(x), F.lit(1.0))
    if kind == "visual":
        doji = (F.col("t_direction") == "DOJI") | (F.col("direction") == "DOJI")
        turn = F.when(F.col("t_direction") == F.col("direction"), 0.0).when(doji, 0.45).otherwise(1.0)
        return [(turn, 1.3), (gap("body_share"), 1.35), (gap("upper_wick_share"), 1.0), (gap("lower_wick_share"), 1.0), (gap("close_location"), 0.55), (logs("range_ticks"), 0.25)], None
    if kind == "dna":
        weights = [(gap, "directional_efficiency", 1.15), (gap, "range_efficiency", 0.95), (gap, "reversal_rate", 0.9), (few, "revisit_rate", 0.8), (other, "high_first", 0.65), (gap, "upper_third_volume_share", 0.45), (gap, "lower_third_volume_share", 0.45), (logs, "path_distance_ticks", 0.55), (logs, "trades", 0.45), (logs, "volume", 0.35), (logs, "trades_per_second", 0.5)]
        return [(f(x), w) for f, x, w in weights], 0.7
    if kind == "structural":
        weights = [(gap, "close_location", 0.8), (gap, "directional_efficiency", 1.0), (gap, "range_efficiency", 1.0), (gap, "reversal_rate", 0.8), (few, "revisit_rate", 0.7), (gap, "upper_third_volume_share", 0.45), (gap, "lower_third_volume_share", 0.45), (logs, "range_ticks", 0.55), (logs, "trades", 0.4), (logs, "volume", 0.35), (other, "high_first", 0.55)]
        return [(gap("body_to_range") / 2, 1.25), *[(f(x), w) for f, x, w in weights]], 0.65
    raise ValueError(kind)


def distance(kind: str) -> Column:
    parts, aggression = _parts(kind)
    total = sum(w for _, w in parts)
    weighted = sum((d * w for d, w in parts), F.lit(0.0))
    if aggression is None:
        return weighted / total
    both = F.abs(F.col("t_aggression_imbalance") - F.col("aggression_imbalance")) / 2 * aggression
    return F.when(both.isNull(), weighted / total).otherwise((weighted + both) / (total + aggression))


def compare(trades: DataFrame, interval: int, first: tuple[str, int], second: tuple[str, int], points: int = 25) -> DataFrame:
    """The normalised paths of two candles (symbol, start), side by side. Only their own trades are read."""
    from ..schema import with_start
    from .trajectory import trajectory_path

    def path(of: tuple[str, int], name: str) -> DataFrame:
        t = with_start(trades, interval).filter((F.col("symbol") == of[0]) & (F.col("start") == of[1]))
        return trajectory_path(t, interval, points).select("point", F.col("y").alias(name))

    both = path(first, "first_y").join(path(second, "second_y"), "point")
    return both.withColumn("difference", F.abs(F.col("first_y") - F.col("second_y")))


def candidates(index: DataFrame, target: DataFrame, *, other_sessions: bool = True, quality_only: bool = False, same_clock_minutes: int | None = None, same: tuple[str, ...] = ()) -> DataFrame:
    """The candles of ``index`` that the one row of ``target`` may be compared with, with the target's columns as ``t_``; the target is broadcast.

    ``same``: columns that must agree (volatility_bucket, session_regime, regime_medium).
    """
    t = target.limit(1).select([F.col(x).alias(f"t_{x}") for x in target.columns])
    found = index.crossJoin(F.broadcast(t)).filter((F.col("start") != F.col("t_start")) | (F.col("symbol") != F.col("t_symbol")))
    if other_sessions:
        found = found.filter("session_date <> t_session_date")
    if quality_only:
        found = found.filter("eligible")
    if same_clock_minutes is not None:
        clock = lambda x: F.floor(F.col(x) % 86_400 / 60)
        found = found.filter(F.abs(clock("start") - clock("t_start")) <= same_clock_minutes)
    for x in same:
        found = found.filter(F.col(x) == F.col(f"t_{x}"))
    return found


def low_quality(index: DataFrame, target: DataFrame, other_sessions: bool = True) -> DataFrame:
    """One row: the candles looked at, those that ``quality_only`` leaves out, and whether the target's own session is eligible."""
    found = candidates(index, target, other_sessions=other_sessions)
    return found.agg(F.count("*").alias("looked_at"), F.count_if(~F.col("eligible")).alias("excluded_low_quality"), F.coalesce(F.bool_and("t_eligible"), F.lit(False)).alias("target_eligible"))


def similar(index: DataFrame, target: DataFrame, kind: str, limit: int = 8, **filters) -> DataFrame:
    """The ``limit`` candles of ``index`` most like the one row of ``target``, by one scan of the index; ``filters`` are those of ``candidates``."""
    found = candidates(index, target, **filters)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - F.round(distance(kind), 9)) * 100)), 1)
    return found.select(*CANDLE, score.alias("score")).orderBy(F.desc("score"), "start", "symbol").limit(max(1, min(limit, 50)))
