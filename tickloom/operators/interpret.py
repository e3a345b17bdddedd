"""Interpretation: evidence quality, facts and hypotheses of each candle, with structured evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.normalize import to_price
from ..schema import CANDLE, indexed_once, ratio, when_chain, whole_candle
from .aggression import candle_flow, level_aggression, top_agents
from .candles import build_candles, timeline
from .dna import candle_dna
from .efficiency import effort_events, efficiency_decay, flow_phases, paradox_flags, paradox_scan
from .simulate import counterfactual_paths
from .waves import RULES, WaveRules, all_waves


def evidence_quality(trades: DataFrame, interval: int) -> DataFrame:
    c = F.col
    flow = candle_flow(trades, interval)
    score = F.when(c("coverage") <= 0, 0.0).otherwise(0.60 * c("coverage") + 0.25 * c("identity_coverage") + 0.15 * F.least(c("trades") / 100.0, F.lit(1.0)))
    out = flow.select(*CANDLE, score.alias("score"), "coverage", "identity_coverage", "trades")
    label = when_chain((c("coverage") <= 0, "INDISPONIVEL"), (c("score") >= 0.80, "ALTA"), (c("score") >= 0.60, "MODERADA"), default="LIMITADA")
    return out.withColumn("label", label)


def _shape(candles: DataFrame) -> dict[str, Column]:
    c = F.col
    span, body = c("high_ticks") - c("low_ticks"), c("close_ticks") - c("open_ticks")
    at = (c("close_ticks") - c("low_ticks")) / span
    return {
        "direction": F.when(body > 0, "ALTA").when(body < 0, "BAIXA").otherwise("NEUTRO"),
        "body_ticks": body,
        "range_ticks": span,
        "upper_wick_ticks": c("high_ticks") - F.greatest("open_ticks", "close_ticks"),
        "lower_wick_ticks": F.least("open_ticks", "close_ticks") - c("low_ticks"),
        "body_abs_share": ratio(F.abs(body), span),
        "close_zone": when_chain((span <= 0, "CENTRO"), (at >= 0.80, "TOPO"), (at <= 0.20, "FUNDO"), default="MEIO"),
    }


def geometry(trades: DataFrame, interval: int) -> DataFrame:
    bars = build_candles(trades, interval)
    return bars.withColumns(_shape(bars)).drop("volume", "trades", "first_us", "last_us")


def facts(trades: DataFrame, interval: int, rules: WaveRules | None = RULES) -> DataFrame:
    """Observed facts: symbol, start, place, code, two figures ``a`` and ``b``, and a ``detail``. ``rules`` None leaves waves out.

    GEOMETRIA: body, range, close zone. AGRESSAO_TOTAL: delta, coverage, whether there are data. COMPOSICAO_AGRESSAO: the shares of buyers and sellers
    in the volume. DIVERGENCIA_PRECO_FLUXO: price change, delta, priority. EFICIENCIA_FLUXO: price change, ticks for 1000 contracts, the
    numbers of effort and decay events. CANDLE_PARADOXAL: score, flags, priority. NIVEL_MAIS_AGREDIDO: price, directed volume, direction.
    AGENTE: quantity and share of the largest agent of a side, with both. ULTIMO_TERMINO_ONDA: pressure decay, end, side and kind of the last wave
    that ended. ONDA_ABERTA_FECHAMENTO: start, peak, side of the open one.
    """
    c = F.col
    trades = indexed_once(trades, interval)
    phases = flow_phases(trades, interval)
    flow = candle_flow(trades, interval)
    per = lambda df, **cols: df.groupBy(*CANDLE).agg(*[v.alias(k) for k, v in cols.items()])
    x = geometry(trades, interval).join(flow.select(*CANDLE, "delta", "directed", "coverage", "relation", "priority", "buy_share_volume", "sell_share_volume", "price_change"), CANDLE)
    top = level_aggression(trades, interval).filter("directed > 0")
    first = F.max_by(F.struct("price_ticks", c("directed").alias("level_directed"), c("direction").alias("level_direction")), F.struct("directed", F.abs("delta"), "volume", "price_ticks"))
    agents = top_agents(trades, interval, 1)
    agent = lambda side: F.max(F.when(c("side") == side, F.struct("quantity", "share", "agent")))
    parts = [
        per(top, top=first),
        per(effort_events(phases), efforts=F.count("*")),
        per(efficiency_decay(phases), decays=F.count("*")),
        paradox_scan(trades, interval).select(*CANDLE, c("score").alias("paradox_score"), c("flags").alias("paradox_flags"), c("priority").alias("paradox_priority")),
        per(agents, buyer=agent("BUY"), seller=agent("SELL")),
    ]
    if rules is not None:
        done = c("end_idx").isNotNull()
        parts.append(per(all_waves(trades, interval, rules), ended=F.max_by(F.when(done, F.struct("pressure_decay", "end_idx", "side", "termination")), F.when(done, c("wave"))), open=F.max(F.when(~done, F.struct("start_idx", "peak_qty", "side")))))
    for part in parts:
        x = x.join(part, CANDLE, "left")
    if rules is None:
        x = x.withColumns({"ended": F.lit(None).cast("struct<pressure_decay:double,end_idx:long,side:string,termination:string>"), "open": F.lit(None).cast("struct<start_idx:long,peak_qty:long,side:string>")})
    none = F.lit(None).cast("string")
    zero = lambda k: F.coalesce(k, F.lit(0)).cast("string")
    fact = lambda code, a, b, detail=none, there=F.lit(True): F.when(there, F.struct(F.lit(code).alias("code"), a.cast("double").alias("a"), b.cast("double").alias("b"), detail.alias("detail")))
    rows = F.array_compact(
        F.array(
            fact("GEOMETRIA", c("body_ticks"), c("range_ticks"), c("close_zone")),
            fact("AGRESSAO_TOTAL", c("delta"), c("coverage"), (c("directed") > 0).cast("string")),
            fact("COMPOSICAO_AGRESSAO", c("buy_share_volume"), c("sell_share_volume")),
            fact("DIVERGENCIA_PRECO_FLUXO", c("price_change"), c("delta"), c("priority"), c("relation") == "DIVERGENTE"),
            fact("EFICIENCIA_FLUXO", c("price_change"), ratio(c("price_change") * 1000.0, c("directed"), None), F.concat_ws("/", zero(c("efforts")), zero(c("decays")))),
            fact("CANDLE_PARADOXAL", c("paradox_score"), c("paradox_flags"), c("paradox_priority"), c("paradox_score").isNotNull()),
            fact("NIVEL_MAIS_AGREDIDO", c("top.price_ticks"), c("top.level_directed"), c("top.level_direction"), c("top").isNotNull()),
            *[fact("AGENTE", c(f"{side}.quantity"), c(f"{side}.share"), F.concat(F.lit(f"{name} "), c(f"{side}.agent")), c(side).isNotNull()) for side, name in (("buyer", "BUY"), ("seller", "SELL"))],
            fact("ULTIMO_TERMINO_ONDA", c("ended.pressure_decay"), c("ended.end_idx"), F.concat_ws(" ", "ended.side", "ended.termination"), c("ended").isNotNull()),
            fact("ONDA_ABERTA_FECHAMENTO", c("open.start_idx"), c("open.peak_qty"), c("open.side"), c("open").isNotNull()),
        )
    )
    return x.select(*CANDLE, F.posexplode(rows).alias("place", "f")).select(*CANDLE, "place", "f.*")


def synthesis(found: DataFrame) -> DataFrame:
    """The two strongest hypotheses of each candle that has any, from ``hypotheses``."""
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("code")))
    return found.groupBy(*CANDLE).agg(at(1).alias("first_code"), at(2).alias("second_code"), F.max("score").alias("best_score"))


def candle_detail(trades: DataFrame, interval: int, tick_size: float, rules: WaveRules = RULES, with_timeline: bool = True, seed: int = 42) -> DataFrame:
    """All that is known of each candle in one row: prices, DNA, levels, flow, phases, waves, paradox flags, facts, hypotheses, a counterfactual path
    and, unless left out, its timeline. The arrays are as long as the candle's own trades and levels; filter the trades for single candles."""
    c = F.col
    trades = indexed_once(trades, interval)
    bars = build_candles(trades, interval)
    prices = {f"{k}_price": to_price(c(f"{k}_ticks"), tick_size) for k in ("open", "high", "low", "close")}
    dna = candle_dna(trades, interval)
    of = lambda df, name, *order: df.groupBy(*CANDLE).agg(F.array_sort(F.collect_list(F.struct(*order, *[k for k in df.columns if k not in CANDLE and k not in order]))).alias(name))
    flags = paradox_flags(trades, interval)
    phases = flow_phases(trades, interval)
    events = effort_events(phases).select(*CANDLE, F.lit("ESFORCO_SEM_RESULTADO").alias("code"), "side", c("phase").alias("from_phase"), c("phase").alias("to_phase"), c("effort_vs_median").alias("value"))
    events = events.unionByName(efficiency_decay(phases).select(*CANDLE, "code", "side", "from_phase", "to_phase", c("efficiency_ratio").alias("value")))
    parts = [
        dna.select(*CANDLE, F.struct(*[k for k in dna.columns if k not in CANDLE], to_price(c("most_traded_price_ticks"), tick_size).alias("most_traded_price"), to_price(c("vwap_ticks"), tick_size).alias("vwap")).alias("dna")),
        of(level_aggression(trades, interval), "levels", "price_ticks"),
        candle_flow(trades, interval).select(*CANDLE, F.struct("buy", "sell", "rlp", "unknown", "delta", "direction", "dominance", "coverage", "relation", "priority").alias("flow")),
        of(phases, "phases", "phase_no"),
        of(events, "events", "code", "side", "from_phase"),
        of(all_waves(trades, interval, rules), "waves", "wave"),
        of(flags, "paradox", "code"),
        of(facts(trades, interval, rules), "facts", "place"),
        of(hypotheses(trades, interval, rules), "hypotheses", "rank"),
        counterfactual_paths(bars, seed=seed).select(*CANDLE, c("prices").alias("counterfactual"), "label"),
    ]
    if with_timeline:
        parts.append(of(timeline(trades, interval), "timeline", "trade_number"))
    out = bars.withColumns(prices)
    for part in parts:
        out = out.join(part, CANDLE, "left")
    return out


def _hypotheses(trades: DataFrame, interval: int, rules: WaveRules | None, efficiency: bool) -> DataFrame:
    c = F.col
    trades = indexed_once(trades, interval)
    phases = flow_phases(trades, interval)
    name = F.when(c("directed") == 0, "SEM_DADOS_AGRESSOR").when(c("dominance") < 0.15, "EQUILIBRADA").when(c("delta") > 0, "COMPRA").otherwise("VENDA")
    ends = phases.withColumn("way", name).groupBy(*CANDLE).agg(F.min_by("way", "phase_no").alias("first_way"), F.max_by("way", "phase_no").alias("last_way"), F.count("*").alias("n_phases"))
    # bars, phases, levels and waves are partitioned by candle already, so they meet without a shuffle
    q = lambda side: F.sum(F.when(c("aggressor") == side, c("quantity")).otherwise(0))
    bars = build_candles(trades, interval, q("BUY").alias("buy"), q("SELL").alias("sell"))
    known = c("buy") + c("sell")
    x = bars.withColumns(_shape(bars) | {"delta": c("buy") - c("sell"), "directed": known, "coverage": ratio(known, c("volume")), "imbalance": ratio(c("buy") - c("sell"), known)}).join(ends, CANDLE)
    levels = level_aggression(trades, interval).withColumns({"top_": F.max("price_ticks").over(whole_candle()), "bottom_": F.min("price_ticks").over(whole_candle())})
    near = levels.filter("response = 'POSSIVEL_ABSORCAO'").groupBy(*CANDLE).agg(F.max(c("top_") - c("price_ticks") <= 1).alias("near_high"), F.max(c("price_ticks") - c("bottom_") <= 1).alias("near_low"))
    x = x.join(near, CANDLE, "left")
    if rules is not None:
        done = c("end_idx").isNotNull()
        found = all_waves(trades, interval, rules).groupBy(*CANDLE).agg(
            F.max(F.when(done & (c("side") == "BUY"), c("end_price"))).alias("buy_end"),
            F.min(F.when(done & (c("side") == "SELL"), c("end_price"))).alias("sell_end"),
            F.max(F.when(~done, c("side"))).alias("open_side"),
        )
        x = x.join(found, CANDLE, "left").withColumns({"ends_high": c("high_ticks") - c("buy_end") <= 2, "ends_low": c("sell_end") - c("low_ticks") <= 2})
    else:
        x = x.withColumns({"ends_high": F.lit(None).cast("boolean"), "ends_low": F.lit(None).cast("boolean"), "open_side": F.lit(None).cast("string")})
    if efficiency:
        effort = effort_events(phases).groupBy(*CANDLE).agg(F.max("effort_vs_median").alias("effort"))
        decay = efficiency_decay(phases).withColumn("r", F.when(c("efficiency_ratio") == 0, 1.0).otherwise(c("efficiency_ratio"))).groupBy(*CANDLE).agg(F.min("r").alias("fall"))
        x = x.join(effort, CANDLE, "left").join(decay, CANDLE, "left")
    else:
        x = x.withColumns({"effort": F.lit(None).cast("double"), "fall": F.lit(None).cast("double")})
    yes = lambda v: F.coalesce(c(v), F.lit(False))
    strength, cov = F.abs("imbalance"), c("coverage")
    up, down = c("close_ticks") > c("open_ticks"), c("close_ticks") < c("open_ticks")
    top, bottom = c("close_zone") == "TOPO", c("close_zone") == "FUNDO"
    plus = lambda cond, v: F.when(cond, v).otherwise(0.0)
    span = F.greatest(c("range_ticks"), F.lit(1))
    upper, lower = c("upper_wick_ticks") / span, c("lower_wick_ticks") / span
    bought = c("open_side") == "BUY"
    wave_fits = F.when(bought, up | top).when(c("open_side") == "SELL", down | bottom).otherwise(False)
    h = lambda code, cond, score: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score")))
    rows = F.array_compact(
        F.array(
            h("AGRESSAO_ALINHADA_ALTA", up & (c("delta") > 0), 0.35 + 0.30 * strength + 0.20 * cov + plus(top, 0.12)),
            h("AGRESSAO_ALINHADA_BAIXA", down & (c("delta") < 0), 0.35 + 0.30 * strength + 0.20 * cov + plus(bottom, 0.12)),
            h("ALTA_COM_DELTA_VENDEDOR", up & (c("delta") < 0), 0.38 + 0.25 * strength + 0.18 * cov),
            h("BAIXA_COM_DELTA_COMPRADOR", down & (c("delta") > 0), 0.38 + 0.25 * strength + 0.18 * cov),
            h("ESFORCO_AGRESSOR_SEM_RESULTADO", c("effort").isNotNull(), 0.48 + F.least(F.lit(0.22), c("effort") * 0.10) + 0.15 * cov),
            h("PERDA_EFICIENCIA_FLUXO", c("fall").isNotNull(), 0.58 + F.least(F.lit(0.20), (1 - F.greatest(F.lit(0.0), c("fall"))) * 0.20)),
            h("REJEICAO_MAXIMA", (upper >= 0.25) & (yes("near_high") | yes("ends_high")), 0.58 + F.least(F.lit(0.18), upper * 0.20) + plus(yes("near_high"), 0.10) + plus(yes("ends_high"), 0.10)),
            h("REJEICAO_MINIMA", (lower >= 0.25) & (yes("near_low") | yes("ends_low")), 0.58 + F.least(F.lit(0.18), lower * 0.20) + plus(yes("near_low"), 0.10) + plus(yes("ends_low"), 0.10)),
            h("ONDA_ABERTA_SUSTENTA_FECHAMENTO", wave_fits, 0.62 + 0.15 * cov),
            h("DISPUTA_EQUILIBRADA", (c("directed") > 0) & (strength < 0.15) & (c("close_zone") == "MEIO"), 0.60 + 0.15 * cov),
            h("MUDANCA_CONTROLE_INTRABAR", (c("n_phases") >= 3) & (c("first_way") != c("last_way")) & c("first_way").isin("COMPRA", "VENDA") & c("last_way").isin("COMPRA", "VENDA"), F.lit(0.66)),
        )
    )
    out = x.select(*CANDLE, "open_side", "last_way", F.posexplode(rows).alias("place", "h")).select(*CANDLE, "h.code", "h.score", "open_side", "last_way", "place")
    confidence = F.when(c("score") >= 0.72, "FORTE").when(c("score") >= 0.48, "MODERADA").otherwise("FRACA")
    rank = F.row_number().over(Window.partitionBy(*CANDLE).orderBy(F.desc("score"), "place"))
    return out.withColumns({"confidence": confidence, "rank": rank})


def hypotheses(trades: DataFrame, interval: int, rules: WaveRules | None = RULES, efficiency: bool = True) -> DataFrame:
    """Hypotheses with scores, best first; ``rules`` None leaves waves out."""
    return _hypotheses(trades, interval, rules, efficiency).select(*CANDLE, "code", "score", "confidence", "rank")
