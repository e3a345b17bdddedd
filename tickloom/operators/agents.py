"""Concentration of agents, and their profiles from session to session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import CANDLE, with_start

#: 32 bands of 2 rows: a pair of similarity 0.5 is missed with probability 1e-4.
BANDS, ROWS = 32, 2
LEAST = 0.5


def by_agent(trades: DataFrame, interval: int) -> DataFrame:
    """Trades of a known side, with the agent who took it ('' where it isn't named)."""
    side = F.col("aggressor")
    agent = F.trim(F.coalesce(F.when(side == "BUY", F.col("buyer_id")).otherwise(F.col("seller_id")), F.lit("")))
    return with_start(trades, interval).filter(side.isin("BUY", "SELL")).withColumns({"side": side, "agent": agent})


def concentration(trades: DataFrame, interval: int, by_level: bool = False) -> DataFrame:
    """Herfindahl index of the named agents of each candle (or price level) and side: the sum of their squared shares of the named quantity, with their
    number, the number of equal ones that would be as concentrated, the largest share, and how much of the quantity is named. One row for each agent is shuffled, no trades."""
    c = F.col
    keys = [*CANDLE, "price_ticks", "side"] if by_level else [*CANDLE, "side"]
    g = by_agent(trades, interval).groupBy(*keys, "agent").agg(F.sum("quantity").alias("q"))
    named = F.when(c("agent") != "", c("q"))
    g = g.groupBy(*keys).agg(F.count(named).alias("agents"), F.sum(named).alias("named"), F.sum("q").alias("quantity"), F.sum(named.cast("double") * named).alias("squares"), F.max(named).alias("most"))
    hhi = c("squares") / (c("named").cast("double") * c("named"))
    return g.filter("named > 0").select(*keys, "agents", "quantity", hhi.alias("hhi"), (1 / hhi).alias("effective_agents"), (c("most") / c("named")).alias("top_share"), (c("named") / c("quantity")).alias("named_share"))


def profiles(trades: DataFrame, interval: int, band_ticks: int, phases: int) -> DataFrame:
    """Distinct (price band, phase of the candle, side) that each agent took part in, by session."""
    us = F.col("us") - F.col("start") * 1_000_000
    phase = F.least(F.floor(us * phases / (interval * 1_000_000)), F.lit(phases - 1))
    t = by_agent(trades, interval).filter("agent <> ''")
    return t.select("symbol", "session_date", "agent", F.concat_ws("|", F.floor(F.col("price_ticks") / band_ticks).cast("string"), phase.cast("string"), "side").alias("item")).distinct()


def profile_matches(trades: DataFrame, interval: int, band_ticks: int = 500, phases: int = 4, least: float = LEAST) -> DataFrame:
    """Agents of a symbol's next session whose profile has a Jaccard similarity of ``least`` or more with an agent's of the session before, and whether it is the
    same name. MinHash bands find candidates; they are verified on the sets themselves."""
    c = F.col
    items = profiles(trades, interval, band_ticks, phases)
    who = ["symbol", "session_date", "agent"]
    mins = [F.min(F.xxhash64(F.lit(k), "item")).alias(f"m{k}") for k in range(BANDS * ROWS)]
    signed = items.groupBy(*who).agg(F.count("*").alias("size"), *mins)
    days = signed.select("symbol", "session_date").distinct().withColumn("next", F.lead("session_date").over(Window.partitionBy("symbol").orderBy("session_date")))  # a row for each session

    def band(k: int) -> Column:
        return F.struct(F.lit(k).alias("band"), F.xxhash64(*[f"m{k * ROWS + r}" for r in range(ROWS)]).alias("hash"))

    bands = signed.select(*who, "size", F.explode(F.array(*[band(k) for k in range(BANDS)])).alias("b")).select(*who, "size", "b.*")
    first = bands.join(days, ["symbol", "session_date"]).select("symbol", c("next").alias("day"), "session_date", c("agent").alias("a"), c("size").alias("size_a"), "band", "hash")
    second = bands.select("symbol", c("session_date").alias("day"), c("agent").alias("b"), c("size").alias("size_b"), "band", "hash")
    pairs = first.join(second, ["symbol", "day", "band", "hash"]).select("symbol", "session_date", "day", "a", "b", "size_a", "size_b").distinct()
    mine = items.select("symbol", "session_date", c("agent").alias("a"), "item")
    theirs = items.select("symbol", c("session_date").alias("day"), c("agent").alias("b"), "item")
    common = pairs.join(mine, ["symbol", "session_date", "a"]).join(theirs, ["symbol", "day", "b", "item"]).groupBy(*pairs.columns).agg(F.count("*").alias("common"))
    likeness = c("common") / (c("size_a") + c("size_b") - c("common"))
    return common.withColumn("similarity", likeness).filter(c("similarity") >= least).select("symbol", "session_date", c("day").alias("next_date"), c("a").alias("agent"), c("b").alias("match"), "common", "similarity", (c("a") == c("b")).alias("same_agent"))
