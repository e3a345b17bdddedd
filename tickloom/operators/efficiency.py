"""Flow efficiency by phase, its events, and paradoxical candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import CANDLE, indexed, ratio, when_chain, whole_candle, with_start
from .aggression import BALANCED, candle_flow, dominance

PHASES = ["INICIO", "MEIO", "FINAL"]
MIN_COVERAGE = 0.30


def side(buy: Column, sell: Column) -> Column:
    return when_chain((buy + sell <= 0, "SEM_DADOS"), (dominance(buy, sell) < BALANCED, "EQUILIBRADO"), (buy > sell, "BUY"), default="SELL")


def flow_phases(trades: DataFrame, interval: int) -> DataFrame:
    """Thirds of a candle by trade number, cut at n div 3 and 2n div 3; the remainder goes to later phases."""
    t = indexed(trades, interval).withColumn("n", F.count("*").over(whole_candle()))
    phase = F.when(F.col("idx") < F.floor(F.col("n") / 3), 0).when(F.col("idx") < F.floor(2 * F.col("n") / 3), 1).otherwise(2)
    q = lambda s: F.sum(F.when(F.col("aggressor") == s, F.col("quantity")).otherwise(0))
    g = t.withColumn("phase_no", phase).groupBy(*CANDLE, "phase_no").agg(
        F.count("*").alias("trades"),
        F.sum("quantity").alias("volume"),
        q("BUY").alias("buy"),
        q("SELL").alias("sell"),
        (F.max_by("price_ticks", "idx") - F.min_by("price_ticks", "idx")).alias("price_change"),
        F.greatest(F.lit(1.0), (F.max("us") - F.min("us")) / 1e6).alias("seconds"),
    )
    c = F.col
    g = g.withColumns({"phase": F.element_at(F.array(*map(F.lit, PHASES)), c("phase_no") + 1), "directed": c("buy") + c("sell"), "delta": c("buy") - c("sell"), "flow_direction": side(c("buy"), c("sell")), "dominance": dominance(c("buy"), c("sell"))})
    g = g.withColumns(
        {
            "contracts_per_second": c("directed") / c("seconds"),
            "buy_response": ratio(c("price_change") * 1000.0, c("buy"), None),
            "sell_response": ratio(c("price_change") * -1000.0, c("sell"), None),
        }
    )
    g = g.withColumn("response", F.when(c("flow_direction") == "BUY", c("buy_response")).when(c("flow_direction") == "SELL", c("sell_response")))
    one = whole_candle()
    g = g.withColumns(
        {
            "effort_vs_median": c("directed") / F.median(F.when(c("directed") > 0, c("directed"))).over(one),
            "usual": F.median(F.when(c("response") > 0, c("response"))).over(one),
        }
    )
    vs = c("response") / c("usual")
    label = when_chain(
        (c("directed") <= 0, "SEM_DADOS"), (c("flow_direction") == "EQUILIBRADO", "FLUXO_EQUILIBRADO"), (c("response") < 0, "RESPOSTA_OPOSTA"), (c("response") == 0, "SEM_RESPOSTA"), (vs >= 1.5, "ALTA"), (vs >= 0.5, "MODERADA"), default="BAIXA"
    )
    return g.withColumn("label", label).drop("usual")


def effort_events(phases: DataFrame) -> DataFrame:
    return phases.filter((F.col("effort_vs_median") >= 1) & F.col("label").isin("BAIXA", "SEM_RESPOSTA", "RESPOSTA_OPOSTA")).select(
        *CANDLE, "phase_no", "phase", F.col("flow_direction").alias("side"), "effort_vs_median", "label", "price_change", "directed"
    )


def efficiency_decay(phases: DataFrame) -> DataFrame:
    """For each side, its first phase against its last, if effort didn't vanish and the response fell to 40 % or less."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s.lower()).alias("volume"), F.col(f"{s.lower()}_response").alias("response")) for s in ("BUY", "SELL")])).alias("x")
    x = phases.select(*CANDLE, "phase_no", "phase", sides).select(*CANDLE, "phase_no", "phase", "x.*").filter("volume > 0")
    at = F.struct("phase", "volume", "response")
    g = x.groupBy(*CANDLE, "side").agg(F.min_by(at, "phase_no").alias("a"), F.max_by(at, "phase_no").alias("b"), F.count("*").alias("n"))
    fall = F.col("b.response") / F.col("a.response")
    g = g.filter((F.col("n") >= 2) & (F.col("a.response") > 0) & (F.col("b.volume") >= F.greatest(F.lit(1), F.floor(F.col("a.volume") * 0.5)))).filter(fall <= 0.4)
    return g.select(
        *CANDLE,
        "side",
        F.concat(F.lit("PERDA_EFICIENCIA_"), "side").alias("code"),
        F.col("a.phase").alias("from_phase"),
        F.col("b.phase").alias("to_phase"),
        F.col("a.response").alias("initial_efficiency"),
        F.col("b.response").alias("final_efficiency"),
        fall.alias("efficiency_ratio"),
        F.col("a.volume").alias("initial_volume"),
        F.col("b.volume").alias("final_volume"),
        (F.col("b.volume") >= F.col("a.volume") * 0.8).alias("not_collapsed"),
    )


def flow_candle(trades: DataFrame, interval: int) -> DataFrame:
    """The whole candle's initiative, effort and response. Balance is tested before a neutral price here."""
    from .candles import build_candles

    c = F.col
    flow = candle_flow(trades, interval).select(*CANDLE, "volume", "trades", "buy", "sell", "price_change", "price_direction", "coverage", "dominance")
    bars = build_candles(trades, interval).select(*CANDLE, (c("high_ticks") - c("low_ticks")).alias("range_ticks"), F.greatest(F.lit(1.0), (c("last_us") - c("first_us")) / 1e6).alias("seconds"))
    g = flow.join(bars, CANDLE).withColumns({"directed": c("buy") + c("sell"), "side": side(c("buy"), c("sell"))})
    with_price = ((c("side") == "BUY") & (c("price_change") > 0)) | ((c("side") == "SELL") & (c("price_change") < 0))
    relation = when_chain((c("side") == "SEM_DADOS", "DADOS_INSUFICIENTES"), (c("side") == "EQUILIBRADO", "FLUXO_EQUILIBRADO"), (c("price_change") == 0, "PRECO_NEUTRO"), (with_price, "ALINHADO"), default="DIVERGENTE")
    return g.withColumns(
        {
            "relation": relation,
            "contracts_per_second": c("directed") / c("seconds"),
            "trades_per_second": c("trades") / c("seconds"),
            "ticks_per_1000": ratio(c("price_change") * 1000.0, c("directed"), None),
            "dominant_response": F.when(c("side") == "BUY", c("price_change") * 1000.0 / c("buy")).when(c("side") == "SELL", c("price_change") * -1000.0 / c("sell")),
        }
    )


def severity(score: Column) -> Column:
    return F.when(score >= 0.8, "MUITO_ALTA").when(score >= 0.6, "ALTA").when(score >= 0.4, "MODERADA").otherwise("BAIXA")


def paradox_flags(trades: DataFrame, interval: int) -> DataFrame:
    """A row for each flag of a candle whose aggressor coverage is 30 % or more.

    A candle's phases, three at most, stand beside its flow as an array, so each flag is an expression of one row and nothing is read or joined twice.
    """
    c = F.col
    flow = flow_candle(trades, interval).filter(c("coverage") >= MIN_COVERAGE)
    parts = ["phase_no", "label", "effort_vs_median", "contracts_per_second", "response", "buy", "sell", "buy_response", "sell_response"]
    phases = flow_phases(trades, interval).groupBy(*CANDLE).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("phases"))
    x = flow.join(phases, CANDLE)

    def flag(when: Column, code: Column, score: Column) -> Column:
        return F.when(when, F.struct(code.alias("code"), F.least(F.lit(1.0), score).alias("score")))

    code = F.when((c("price_change") < 0) & (c("buy") > c("sell")), "BAIXA_COM_COMPRA_AGRESSORA_DOMINANTE").when((c("price_change") > 0) & (c("sell") > c("buy")), "ALTA_COM_VENDA_AGRESSORA_DOMINANTE").otherwise("DIVERGENCIA_PRECO_FLUXO")
    divergent = flag(c("relation") == "DIVERGENTE", code, 0.45 + 0.30 * F.coalesce("dominance", F.lit(0.0)) + 0.25 * c("coverage"))
    strong = F.filter("phases", lambda p: (p["effort_vs_median"] >= 1) & p["label"].isin("BAIXA", "SEM_RESPOSTA", "RESPOSTA_OPOSTA"))
    effort = F.array_max(F.transform(strong, lambda p: p["effort_vs_median"]))
    efforts = flag(effort.isNotNull(), F.lit("AGRESSAO_FORTE_SEM_DESLOCAMENTO"), 0.35 + F.least(effort, F.lit(2.0)) * 0.20 + 0.25 * c("coverage"))

    def decay(side_: str) -> Column:
        """The side's first phase against its last, as in ``efficiency_decay``."""
        of, response = side_.lower(), f"{side_.lower()}_response"
        some = F.filter("phases", lambda p: p[of] > 0)
        first, last = F.get(some, F.lit(0)), F.element_at(F.when(F.size(some) > 0, some), -1)
        fall = last[response] / first[response]
        fell = (F.size(some) >= 2) & (first[response] > 0) & (last[of] >= F.greatest(F.lit(1), F.floor(first[of] * 0.5))) & (fall <= 0.4)
        # a ratio of exactly 0 counts as 1
        left = F.when(fall == 0, 1.0).otherwise(fall)
        return flag(fell, F.lit(f"PERDA_EFICIENCIA_{side_}"), 0.55 + (1 - F.greatest(F.lit(0.0), left)) * 0.35)

    def faster(p: Column, i: Column) -> Column:
        before = F.get("phases", i - 1)
        quick = (p["contracts_per_second"] > before["contracts_per_second"] * 1.15) & (p["response"] < before["response"] * 0.60)
        return flag((i > 0) & quick, F.lit("AGRESSAO_ACELERA_E_EFICIENCIA_CAI"), 0.62 + F.least(p["contracts_per_second"] / F.greatest(before["contracts_per_second"], F.lit(1e-9)) - 1, F.lit(1.0)) * 0.20)

    flags = F.array_compact(F.concat(F.array(divergent, efforts, decay("BUY"), decay("SELL")), F.transform("phases", faster)))
    found = x.select(*CANDLE, flags.alias("flags")).select(*CANDLE, F.explode_outer("flags").alias("flag")).filter("flag IS NOT NULL").select(*CANDLE, "flag.*")
    return found.withColumn("severity", severity(c("score")))


def paradox_scan(trades: DataFrame, interval: int) -> DataFrame:
    """Paradoxical candles with their highest score."""
    g = paradox_flags(trades, interval).groupBy(*CANDLE).agg(F.max("score").alias("score"), F.count("*").alias("flags"))
    return g.withColumn("priority", severity(F.col("score")))


def paradox_ranking(trades: DataFrame, interval: int, limit: int = 50) -> DataFrame:
    """Each symbol's ``limit`` paradoxical candles of the highest score, then the first, with the candles looked at and the paradoxical ones' share."""
    found = paradox_scan(trades, interval)
    all_ = with_start(trades, interval).select(*CANDLE).distinct().groupBy("symbol").agg(F.count("*").alias("candles"))
    by = Window.partitionBy("symbol").orderBy(F.desc(F.round("score", 12)), "start")
    some = found.groupBy("symbol").agg(F.count("*").alias("paradoxical"))
    top = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= max(1, min(limit, 200)))
    return top.join(all_.join(some, "symbol"), "symbol").withColumn("share", F.col("paradoxical") / F.col("candles"))
