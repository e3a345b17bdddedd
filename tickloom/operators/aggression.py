"""Aggression by price level and agent, and the candle's flow summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import CANDLE, in_candle, indexed, is_rlp, ratio, when_chain, whole_candle, with_start

BALANCED = 0.15


def dominance(buy: Column, sell: Column) -> Column:
    return ratio(F.abs(buy - sell), buy + sell, None)


def direction(buy: Column, sell: Column) -> Column:
    return when_chain((buy + sell == 0, "SEM_DIRECAO"), (dominance(buy, sell) < BALANCED, "EQUILIBRADA"), (buy > sell, "COMPRA"), default="VENDA")


def _sums() -> dict[str, Column]:
    q = lambda c: F.sum(F.when(c, F.col("quantity")).otherwise(0))
    buy, sell = F.col("aggressor") == "BUY", F.col("aggressor") == "SELL"
    return {"buy": q(buy), "sell": q(sell), "rlp": q(is_rlp()), "unknown": q(~buy & ~sell & ~is_rlp())}


def level_aggression(trades: DataFrame, interval: int) -> DataFrame:
    """A row for each candle and price: flow, intensity among the candle's levels, and what prices did
    after the level's last trade."""
    w = in_candle()
    # backwards, so that each trade adds to what the later ones gave; a frame that ends with the candle is computed anew for every row
    after = Window.partitionBy(*CANDLE).orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    t = indexed(trades, interval).withColumns(
        {
            "visit": F.coalesce(F.col("price_ticks") != F.lag("price_ticks").over(w), F.lit(True)).cast("int"),
            "after_max": F.max("price_ticks").over(after),
            "after_min": F.min("price_ticks").over(after),
            "n": F.count("*").over(whole_candle()),
        }
    )
    g = t.groupBy(*CANDLE, "price_ticks").agg(
        F.sum("quantity").alias("volume"),
        F.count("*").alias("trades"),
        *[c.alias(k) for k, c in _sums().items()],
        F.sum("visit").alias("visits"),
        F.max(F.struct("idx", "after_max", "after_min")).alias("last"),
        F.max("n").alias("n"),
    )
    buy, sell, p = F.col("buy"), F.col("sell"), F.col("price_ticks")
    directed = buy + sell
    # levels without directed volume form partitions of their own, so that they don't count in the ranks
    some = Window.partitionBy(*CANDLE, directed > 0)
    g = g.withColumns({"directed": directed, "delta": buy - sell, "direction": direction(buy, sell), "dominance": dominance(buy, sell)})
    g = g.withColumns({"rank_": F.cume_dist().over(some.orderBy("directed")), "median_": F.median("directed").over(some), "levels": F.count("*").over(some), "known": F.sum("directed").over(whole_candle())})
    positive = F.col("directed") > 0
    vs_median = F.when(positive, F.col("directed") / F.col("median_")).otherwise(0.0)
    rank = F.when(positive, F.col("rank_")).otherwise(0.0)
    few = F.col("levels") < 4
    by = lambda high, mid, low: ((few & (vs_median >= high)) | (~few & (rank >= mid)), low)
    intensity = when_chain((~positive, "SEM_AGRESSAO_DIRECIONADA"), by(2.5, 0.90, "EXTREMA"), by(1.5, 0.70, "ALTA"), by(0.75, 0.40, "MODERADA"), default="BAIXA")
    up = F.greatest(F.lit(0), F.coalesce(F.col("last.after_max") - p, F.lit(0)))
    down = F.greatest(F.lit(0), F.coalesce(p - F.col("last.after_min"), F.lit(0)))
    bought, sold = F.col("direction") == "COMPRA", F.col("direction") == "VENDA"
    g = g.withColumns(
        {
            "intensity": intensity,
            "percentile": rank,
            "vs_median": vs_median,
            "favorable_ticks": F.when(bought, up).when(sold, down).otherwise(0),
            "adverse_ticks": F.when(bought, down).when(sold, up).otherwise(0),
            "future": F.col("n") - 1 - F.col("last.idx"),
            "share": ratio(F.col("directed"), F.col("known")),
        }
    )
    weak = ~F.col("intensity").isin("ALTA", "EXTREMA") | (F.col("dominance") < 0.5)
    response = when_chain(
        (~bought & ~sold, "DISPUTA_OU_INDEFINIDA"),
        (F.col("future") <= 0, "SEM_JANELA_POS_AGRESSAO"),
        (weak, "PRESSAO_SEM_CONFIRMACAO"),
        ((F.col("favorable_ticks") >= 2) & (F.col("favorable_ticks") > F.col("adverse_ticks")), "IMPULSO_COMPATIVEL"),
        ((F.col("favorable_ticks") <= 1) & (F.col("visits") > 1), "POSSIVEL_ABSORCAO"),
        default="PRESSAO_SEM_CONFIRMACAO",
    )
    return g.withColumn("response", response).drop("last", "n", "rank_", "median_", "levels", "known")


def strongest_levels(levels: DataFrame, limit: int = 8) -> DataFrame:
    w = Window.partitionBy(*CANDLE).orderBy(F.desc("directed"), F.desc(F.abs("delta")), F.desc("volume"), F.desc("price_ticks"))
    return levels.filter("directed > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def top_agents(trades: DataFrame, interval: int, limit: int = 8, by_level: bool = False) -> DataFrame:
    """Largest agents by side; blank agents aren't ranked, but count in the shares' denominator."""
    keys = [*CANDLE, "price_ticks", "side"] if by_level else [*CANDLE, "side"]
    side = F.col("aggressor")
    agent = F.trim(F.coalesce(F.when(side == "BUY", F.col("buyer_id")).otherwise(F.col("seller_id")), F.lit("")))
    t = with_start(trades, interval).filter(side.isin("BUY", "SELL")).withColumns({"side": side, "agent": agent})
    g = t.groupBy(*keys, "agent").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("trades"))
    g = g.withColumn("share", F.col("quantity") / F.sum("quantity").over(Window.partitionBy(*keys))).filter("agent <> ''")
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("quantity"), "agent"))).filter(F.col("rank") <= limit)


def candle_flow(trades: DataFrame, interval: int) -> DataFrame:
    """The flow summary of each candle, by one aggregation."""
    from ..schema import order_key

    key = order_key(trades)
    buy_, sell_ = F.col("aggressor") == "BUY", F.col("aggressor") == "SELL"
    one = lambda c: F.sum(c.cast("int"))
    named = lambda side, who: side & (F.trim(F.coalesce(who, F.lit(""))) != "")
    g = with_start(trades, interval).groupBy(*CANDLE).agg(
        F.sum("quantity").alias("volume"),
        F.count("*").alias("trades"),
        *[c.alias(k) for k, c in _sums().items()],
        one(buy_).alias("buy_trades"),
        one(sell_).alias("sell_trades"),
        one(is_rlp()).alias("rlp_trades"),
        F.sum(F.when(named(buy_, F.col("buyer_id")) | named(sell_, F.col("seller_id")), F.col("quantity")).otherwise(0)).alias("identified"),
        (F.max_by("price_ticks", key) - F.min_by("price_ticks", key)).alias("price_change"),
        F.count_distinct("price_ticks").alias("levels"),
    )
    c = F.col
    known = c("buy") + c("sell")
    g = g.withColumns(
        {
            "directed": known,
            "delta": c("buy") - c("sell"),
            "direction": direction(c("buy"), c("sell")),
            "dominance": dominance(c("buy"), c("sell")),
            "unknown_trades": c("trades") - c("buy_trades") - c("sell_trades") - c("rlp_trades"),
            "coverage": ratio(known, c("volume")),
            "identity_coverage": ratio(c("identified"), known),
            "price_direction": F.when(c("price_change") > 0, "ALTA").when(c("price_change") < 0, "BAIXA").otherwise("NEUTRO"),
            **{f"{x}_share_volume": ratio(c(x), c("volume")) for x in ("buy", "sell", "rlp", "unknown")},
            **{f"{x}_share_directed": ratio(c(x), known) for x in ("buy", "sell")},
            **{f"{x}_share_trades": c(f"{x}_trades") / c("trades") for x in ("buy", "sell", "rlp")},
        }
    )
    aligned = ((c("price_direction") == "ALTA") & (c("direction") == "COMPRA")) | ((c("price_direction") == "BAIXA") & (c("direction") == "VENDA"))
    relation = when_chain(
        (c("directed") <= 0, "DADOS_INSUFICIENTES"), (c("price_direction") == "NEUTRO", "PRECO_NEUTRO"), (c("direction") == "EQUILIBRADA", "FLUXO_EQUILIBRADO"), (aligned, "ALINHADO"), default="DIVERGENTE"
    )
    g = g.withColumns({"unknown_share_trades": c("unknown_trades") / c("trades"), "relation": relation})
    priority = when_chain(
        (c("relation") != "DIVERGENTE", "NORMAL"), ((c("coverage") >= 0.70) & (c("dominance") >= 0.20), "ALTA"), (c("coverage") >= 0.50, "MODERADA"), default="BAIXA"
    )
    return g.withColumn("priority", priority)
