"""Historical validation: what followed each hypothesis, against the base rate of the same candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import CANDLE, indexed_once
from .candles import build_candles
from .interpret import _hypotheses
from .quality import SESSION
from .research import with_session
from .waves import RULES, WaveRules

Z = 1.959963984540054
#: The hypotheses that expect a rise, and those that expect a fall.
UP = ["AGRESSAO_ALINHADA_ALTA", "ALTA_COM_DELTA_VENDEDOR", "REJEICAO_MINIMA"]
DOWN = ["AGRESSAO_ALINHADA_BAIXA", "BAIXA_COM_DELTA_COMPRADOR", "REJEICAO_MAXIMA"]


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    p, z2 = hits / n, Z * Z
    below = 1 + z2 / n
    center = (p + z2 / (2 * n)) / below
    margin = Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n) / below
    return F.greatest(F.lit(0.0), center - margin), F.least(F.lit(1.0), center + margin)


def sample_status(n: Column) -> Column:
    return F.when(n < 30, "AMOSTRA_INSUFICIENTE").when(n < 100, "EXPLORATORIA").when(n < 500, "PRELIMINAR").otherwise("AMOSTRA_MAIOR")


def gated(trades: DataFrame, interval: int, references: DataFrame | None = None, include_synthetic: bool = False) -> DataFrame:
    """Candles with ``excluded``: SYNTHETIC, NO_REFERENCE, REFERENCE_MISMATCH or null."""
    c = F.col
    x = build_candles(trades, interval, F.max(F.lower(F.coalesce("source", F.lit(""))).startswith("synthetic")).alias("synthetic"))
    reason = F.when(c("synthetic") & F.lit(not include_synthetic), "SYNTHETIC")
    if references is not None:
        refs = references.filter(c("interval_seconds") == interval).select(*CANDLE, *[c(f"{f}_ticks").alias(f"ref_{f}") for f in ("open", "high", "low", "close")], c("volume").alias("ref_volume"))
        same = (F.coalesce("ref_volume", "volume") == c("volume"))
        for f in ("open", "high", "low", "close"):
            same = same & (c(f"{f}_ticks") == c(f"ref_{f}"))
        x = x.join(refs, CANDLE, "left")
        reason = reason.when(c("ref_open").isNull(), "NO_REFERENCE").when(~same, "REFERENCE_MISMATCH")
    return with_session(x.withColumn("excluded", reason)).select(*CANDLE, "session_date", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "excluded")


def exclusions(candles: DataFrame) -> DataFrame:
    return candles.groupBy("symbol", F.coalesce("excluded", F.lit("ELIGIBLE")).alias("reason")).agg(F.count("*").alias("candles"))


def _ahead(candles: DataFrame, interval: int, horizons: list[int]) -> DataFrame:
    """A row for each eligible candle and horizon whose whole future is eligible and on the same day."""
    c = F.col
    w = Window.partitionBy(*SESSION).orderBy("start")
    x = candles.filter("excluded IS NULL")
    outcomes = []
    for h in horizons:
        frame = w.rowsBetween(1, h)
        # starts are distinct points of a grid: if the h-th next is h steps away, all between are there
        there = F.lead("start", h).over(w) == c("start") + h * interval
        outcomes.append(F.when(there, F.struct(F.lit(h).alias("horizon"), (F.lead("close_ticks", h).over(w) - c("close_ticks")).alias("delta"), F.greatest(F.lit(0), F.max("high_ticks").over(frame) - c("close_ticks")).alias("up"), F.greatest(F.lit(0), c("close_ticks") - F.min("low_ticks").over(frame)).alias("down"))))
    return x.select(*CANDLE, F.array_compact(F.array(*outcomes)).alias("o")).select(*CANDLE, F.explode("o").alias("o")).select(*CANDLE, "o.*")


def direction_baseline(candles: DataFrame, interval: int, horizons: list[int]) -> DataFrame:
    g = _ahead(candles, interval, horizons).groupBy("symbol", "horizon").agg(F.count("*").alias("eligible"), F.count_if(F.col("delta") > 0).alias("up"), F.count_if(F.col("delta") < 0).alias("down"))
    n = F.col("eligible")
    return g.withColumns({"flat": n - F.col("up") - F.col("down"), "up_rate": F.col("up") / n, "down_rate": F.col("down") / n})


def _outcomes(trades: DataFrame, candles: DataFrame, interval: int, horizons: list[int], rules: WaveRules | None) -> DataFrame:
    """A row for each hypothesis and horizon that has an outcome."""
    c = F.col
    wave = F.when(c("open_side") == "BUY", "UP").when(c("open_side") == "SELL", "DOWN")
    last = F.when(c("last_way") == "COMPRA", "UP").when(c("last_way") == "VENDA", "DOWN")
    way = F.when(c("code").isin(UP), "UP").when(c("code").isin(DOWN), "DOWN").when(c("code") == "ONDA_ABERTA_SUSTENTA_FECHAMENTO", wave).when(c("code") == "MUDANCA_CONTROLE_INTRABAR", last)
    h = _hypotheses(trades, interval, rules, efficiency=False).withColumn("way", way).filter("way IS NOT NULL")
    x = h.join(_ahead(candles, interval, horizons), CANDLE)
    up = c("way") == "UP"
    return x.withColumns({"aligned": F.when(up, c("delta")).otherwise(-c("delta")), "favorable": F.when(up, c("up")).otherwise(c("down")), "adverse": F.when(up, c("down")).otherwise(c("up"))})


def calibrated_hypotheses(trades: DataFrame, interval: int, horizons: list[int], references: DataFrame | None = None, rules: WaveRules | None = RULES, least: int = 1) -> DataFrame:
    """Each session's hypotheses by score bin, with the share of hits that earlier sessions' outcomes give such scores (``calibrate.walk_forward``).
    An outcome that reaches into a later session would not be known there; none does, as candles look ahead within their session."""
    from .calibrate import walk_forward
    from .research import with_session

    trades = indexed_once(trades, interval)
    x = with_session(_outcomes(trades, gated(trades, interval, references), interval, horizons, rules))
    return walk_forward(x.withColumn("hit", F.col("aligned") > 0), ["symbol", "code", "horizon"], least=least)


def hypothesis_outcomes(trades: DataFrame, interval: int, horizons: list[int], references: DataFrame | None = None, rules: WaveRules | None = RULES, include_synthetic: bool = False) -> DataFrame:
    """Hits of each hypothesis by horizon and direction, with Wilson's interval, the base rate and the lift.

    ``confidence`` is null in the row over all confidences, else that of the hypotheses it counts.
    """
    c = F.col
    trades = indexed_once(trades, interval)  # gates, bars, phases, levels and waves come from one shuffle of the trades
    candles = gated(trades, interval, references, include_synthetic)
    x = _outcomes(trades, candles, interval, horizons, rules)
    sets = [["symbol", "code", "horizon", "way"], ["symbol", "code", "horizon", "way", "confidence"]]
    g = x.groupingSets([[c(k) for k in s] for s in sets], *[c(k) for k in sets[1]]).agg(
        F.count("*").alias("n"),
        F.count_if(c("aligned") > 0).alias("hits"),
        F.count_if(c("aligned") >= 2).alias("two_tick_hits"),
        F.avg("aligned").alias("mean_aligned"),
        F.avg("favorable").alias("mean_favorable"),
        F.avg("adverse").alias("mean_adverse"),
        F.avg("score").alias("mean_score"),
    )
    base = direction_baseline(candles, interval, horizons).select("symbol", "horizon", "up_rate", "down_rate")
    g = g.join(base, ["symbol", "horizon"])
    low, high = wilson(c("hits"), c("n"))
    rate = F.when(c("way") == "UP", c("up_rate")).otherwise(c("down_rate"))
    return g.select(
        "symbol", "code", "horizon", "way", "confidence", "n", "hits", "two_tick_hits", (c("hits") / c("n")).alias("hit_rate"), low.alias("wilson_low"), high.alias("wilson_high"),
        rate.alias("baseline_rate"), ((c("hits") / c("n") - rate) * 100).alias("lift_points"), sample_status(c("n")).alias("sample_status"), "mean_aligned", "mean_favorable", "mean_adverse", "mean_score",
    )
