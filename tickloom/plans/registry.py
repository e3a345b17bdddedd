"""Queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import agents, aggression, candles, dna, efficiency, interpret, intervals, quality, reconcile, research, simulate, trajectory, transitions, validation, waves
from ..sources import csv_trades, derived, driver_tables, store
from ..sources.scratch import shared_folder
from ..streaming import live as streaming_live
from ..schema import is_rlp, micros
from . import sql as queries_sql
from .sql import N, sql

HORIZONS = [1, 3, 5]
#: Daily candles have enough trades for the waves' windows.
DAY_S = 86_400
DAILY = [quality.Schedule("DAILY", "SYM", 0, 86_400)]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, frame: Callable[..., DataFrame], columns: str, source: str = "", *more: str) -> None:
    """Registers a query. ``columns``: names, or name=SQL expression, with ~ before doubles (rounded to 6
    places on both sides), by semicolons;
    ~~ leaves doubles as they are (both sides do the same operations). ``frame`` takes trades, or trades and references. No ``source``: no SQL."""
    specs = [c.strip() for c in columns.split(";")]
    places = lambda c: -1 if c.startswith("~~") else 6 if c.startswith("~") else 0
    names = [(c.lstrip("~").partition("=")[0].strip(), places(c), c.partition("=")[2].strip()) for c in specs]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        takes = frame.__code__.co_argcount
        out = frame(*[source(spark, sf_dir) for source in (driver_tables.trades, driver_tables.references)[:takes]])
        # adding 0.0 makes -0.0 plain 0.0
        return out.select([(F.round(F.col(n).cast("double"), d) + 0.0).alias(n) if d > 0 else F.col(n).alias(n) for n, d, _ in names])

    QUERIES[name] = query
    if source:
        picked = ", ".join(f"round(CAST({e or n} AS DOUBLE), {d}) + 0.0 AS {n}" if d > 0 else f"{e or n} AS {n}" for n, d, e in names)
        SQL[name] = sql(f"SELECT {picked} {source}", *more)


ID = "symbol; start"
OHLC = "open_ticks=o; high_ticks=h; low_ticks=l; close_ticks=c; volume=v; trades=k"

add("candles_ohlcv", lambda t: candles.build_candles(t, N), f"{ID}; {OHLC}; first_us=us0; last_us=us1", "FROM c")
add(
    "candles_rollup_multi_interval",
    lambda t: candles.multi_interval(t, [900, 3600, N]),
    "symbol; interval_seconds=CAST(n AS INTEGER); start=s; open_ticks=arg_min(p, (us, seq)); high_ticks=max(p); low_ticks=min(p); close_ticks=arg_max(p, (us, seq)); volume=CAST(sum(q) AS BIGINT); trades=count(*)",
    "FROM (SELECT t.* EXCLUDE (start), n, us // 1000000 // n * n AS s FROM t CROSS JOIN (VALUES (900), (3600), (14400)) x(n)) GROUP BY symbol, n, s",
)
add("symbol_overview", lambda t: candles.symbol_overview(t), "symbol; trades=count(*); first_us=min(us); last_us=max(us)", "FROM t GROUP BY symbol")
add("session_overview", lambda t: candles.session_overview(t), "symbol; session_date; trades=count(*); first_us=min(us); last_us=max(us); volume=CAST(sum(q) AS BIGINT)", "FROM t GROUP BY symbol, session_date")
add("reference_overview", lambda t, r: candles.reference_overview(r), f"symbol; interval_seconds={N}; candles=count(*); first_start=min(start); last_start=max(start); source='reference'", "FROM refs GROUP BY symbol")
add("store_stats", lambda t, r: candles.store_stats(t, r), "trades=(SELECT count(*) FROM t); symbols=(SELECT count(DISTINCT symbol) FROM t); sessions=(SELECT count(*) FROM (SELECT DISTINCT symbol, session_date FROM t)); reference_candles=(SELECT count(*) FROM refs)", " ")
add("library_overview", lambda t: candles.library_overview(t, quality.session_quality(t, DAILY)), "symbol; session_date; trades; status; ~score", "FROM ql")
add("instrument_overview", lambda t, r: candles.instrument_overview(r.select("symbol").distinct(), t), "symbol; trades=count(*); first_us=min(us); last_us=max(us)", "FROM t GROUP BY symbol")
add("trades_slice", lambda t: candles.slice_trades(t, 1_705_312_800_000_000, 1_705_399_200_000_000), "symbol; sequence_no=seq; us; price_ticks=p; quantity=q; aggressor=side", "FROM t WHERE us >= 1705312800000000 AND us < 1705399200000000")
DNA = "~directional_efficiency; ~range_efficiency; ~body_to_range; ~close_location; ~reversal_rate; ~time_to_high_ms; ~time_to_low_ms; ~revisit_rate; ~vwap_ticks; ~mean_trade_size; ~aggressor_coverage; ~aggression_imbalance; ~upper_third_volume_share; ~middle_third_volume_share; ~lower_third_volume_share; ~~avg_intertrade_ms; ~median_intertrade_ms; ~p95_intertrade_ms; ~max_intertrade_ms; ~trades_per_second"
DOUBLES = {x.strip("~ "): x.strip() for x in DNA.split(";")}
for part, names in dna.PARTS.items():
    add(part, lambda t: dna.candle_dna(t, N), "; ".join([ID, *[DOUBLES.get(x, x) for x in names]]), "FROM dna")
add("candle_dna", lambda t: dna.candle_dna(t, N), "; ".join([ID, "trades", "volume", *[DOUBLES.get(x, x) for names in dna.PARTS.values() for x in names]]), "FROM dna")
W = "(PARTITION BY symbol, start ORDER BY idx ROWS UNBOUNDED PRECEDING)"
add(
    "timeline_running",
    lambda t: candles.timeline(t, N),
    f"{ID}; trade_number=idx + 1; us; open_ticks=first_value(p) OVER w; high_ticks=max(p) OVER w; low_ticks=min(p) OVER w; close_ticks=p; volume=CAST(sum(q) OVER w AS BIGINT); buy=CAST(coalesce(sum(q) FILTER (WHERE side = 'BUY') OVER w, 0) AS BIGINT); sell=CAST(coalesce(sum(q) FILTER (WHERE side = 'SELL') OVER w, 0) AS BIGINT); ~imbalance=sum(CASE side WHEN 'BUY' THEN q WHEN 'SELL' THEN -q ELSE 0 END) OVER w / nullif(sum(CASE WHEN side <> 'NONE' THEN q ELSE 0 END) OVER w, 0)",
    f"FROM b WINDOW w AS {W}",
)
add("volume_profile", lambda t: candles.volume_profile(t, N), f"{ID}; price_ticks=p; volume; buy; sell; unknown=rlp + unknown; delta; trades", "FROM lv")
add(
    "level_aggression",
    lambda t: aggression.level_aggression(t, N),
    f"{ID}; price_ticks=p; volume; trades; buy; sell; rlp; unknown; visits; directed; delta; direction; ~dominance; intensity; ~percentile; ~vs_median; ~share; favorable_ticks; adverse_ticks; future; response",
    "FROM lv",
)
add("level_intensity", lambda t: aggression.level_aggression(t, N), f"{ID}; price_ticks=p; directed; intensity; ~percentile; ~vs_median", "FROM lv")
add("level_response", lambda t: aggression.level_aggression(t, N), f"{ID}; price_ticks=p; direction; favorable_ticks; adverse_ticks; future; response", "FROM lv")
add("strongest_levels", lambda t: aggression.strongest_levels(aggression.level_aggression(t, N)), f"{ID}; price_ticks=p; directed; delta; rank", "FROM (SELECT *, row_number() OVER (PARTITION BY symbol, start ORDER BY directed DESC, abs(delta) DESC, volume DESC, p DESC) AS rank FROM lv WHERE directed > 0) WHERE rank <= 8")
AGENTS = "ag AS (SELECT *, q_ / sum(q_) OVER (PARTITION BY {k}, side) AS share FROM (SELECT {k}, side, CASE side WHEN 'BUY' THEN buyer ELSE seller END AS agent, sum(q) AS q_, count(*) AS n_ FROM b WHERE side <> 'NONE' GROUP BY ALL)), ar AS (SELECT *, row_number() OVER (PARTITION BY {k}, side ORDER BY q_ DESC, agent) AS rank FROM ag WHERE agent <> '')"
add("top_agents", lambda t: aggression.top_agents(t, N), f"{ID}; side; agent; quantity=CAST(q_ AS BIGINT); trades=n_; ~share; rank", "FROM ar WHERE rank <= 8", AGENTS.format(k="symbol, start"))
add("top_agents_by_level", lambda t: aggression.top_agents(t, N, 3, by_level=True), f"{ID}; price_ticks=p; side; agent; quantity=CAST(q_ AS BIGINT); trades=n_; ~share; rank", "FROM ar WHERE rank <= 3", AGENTS.format(k="symbol, start, p"))
SHARES = "; ".join([f"~{x}_share_volume={x} / volume" for x in ("buy", "sell", "rlp", "unknown")] + [f"~{x}_share_directed=CASE WHEN directed > 0 THEN {x} / directed ELSE 0 END" for x in ("buy", "sell")] + [f"~{x}_share_trades={x}_trades / trades" for x in ("buy", "sell", "rlp")])
add("candle_flow", lambda t: aggression.candle_flow(t, N), f"{ID}; volume; trades; buy; sell; rlp; unknown; buy_trades; sell_trades; rlp_trades; directed; delta; direction; ~dominance; ~coverage; ~identity_coverage; price_change; price_direction; relation; priority; levels; {SHARES}", "FROM f")
add(
    "pressure_window",
    lambda t: waves.pressure_window(t, N),
    f"{ID}; idx; buy=CAST(coalesce(sum(q) FILTER (WHERE side = 'BUY') OVER w, 0) AS BIGINT); sell=CAST(coalesce(sum(q) FILTER (WHERE side = 'SELL') OVER w, 0) AS BIGINT); total=CAST(sum(q) OVER w AS BIGINT); ~signed_dominance=coalesce(sum(CASE side WHEN 'BUY' THEN q WHEN 'SELL' THEN -q ELSE 0 END) OVER w / nullif(sum(CASE WHEN side <> 'NONE' THEN q ELSE 0 END) OVER w, 0), 0); ~coverage=sum(CASE WHEN side <> 'NONE' THEN q ELSE 0 END) OVER w / sum(q) OVER w",
    "FROM b WINDOW w AS (PARTITION BY symbol, start ORDER BY idx ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)",
)
DAILY_WAVES = queries_sql.waves("wv", DAY_S, waves.RULES)
SHORT_WAVES = queries_sql.waves("wn", N, waves.RULES)
add("waves", lambda t: waves.waves(t, DAY_S), f"{ID}; wave; side; start_idx; peak_idx; peak_qty; ~peak_dominance; end_idx; termination; end_side_qty; end_opposite_qty; ~end_coverage; ~end_dominance; ~pressure_decay", "FROM wv WHERE end_idx IS NOT NULL", *DAILY_WAVES)
add("open_waves", lambda t: waves.open_waves(t, DAY_S), f"{ID}; wave; side; start_idx; peak_qty; ~peak_dominance; last_idx; status='ABERTA_NO_FIM_DO_CANDLE'", "FROM wv WHERE end_idx IS NULL", *DAILY_WAVES)
add("wave_post_event", lambda t: waves.wave_post_event(t, DAY_S), f"{ID}; wave; side; termination; end_idx; observations; max_reversal_ticks; max_continuation_ticks; first_reversal_offset; outcome=CASE WHEN observations = 0 THEN 'SEM_JANELA_POSTERIOR' WHEN max_reversal_ticks >= 2 AND max_reversal_ticks > max_continuation_ticks THEN 'REVERSAO_COMPATIVEL' WHEN max_continuation_ticks >= 2 AND max_continuation_ticks > max_reversal_ticks THEN 'CONTINUACAO' ELSE 'ESTAGNACAO_OU_DISPUTA' END",
    """FROM (SELECT v.symbol, v.start, v.wave, any_value(v.side) AS side, any_value(v.termination) AS termination, any_value(v.end_idx) AS end_idx, count(b.p) AS observations,
      greatest(0, coalesce(max(CASE v.side WHEN 'BUY' THEN v.end_price - b.p ELSE b.p - v.end_price END), 0)) AS max_reversal_ticks, greatest(0, coalesce(max(CASE v.side WHEN 'BUY' THEN b.p - v.end_price ELSE v.end_price - b.p END), 0)) AS max_continuation_ticks,
      min(b.idx - v.end_idx) FILTER (WHERE CASE v.side WHEN 'BUY' THEN v.end_price - b.p ELSE b.p - v.end_price END >= 2) AS first_reversal_offset
      FROM wv v LEFT JOIN wv_b b ON b.symbol = v.symbol AND b.start = v.start AND b.idx BETWEEN v.end_idx + 1 AND v.end_idx + 50 WHERE v.end_idx IS NOT NULL GROUP BY v.symbol, v.start, v.wave)""",
    *DAILY_WAVES,
)
add("wave_agents", lambda t: waves.wave_agents(t, DAY_S), f"{ID}; wave; side; agent; quantity=CAST(q_ AS BIGINT); trades=n_; ~share; rank",
    """FROM (SELECT *, row_number() OVER (PARTITION BY symbol, start, wave ORDER BY q_ DESC, agent) AS rank FROM (SELECT *, q_ / sum(q_) OVER (PARTITION BY symbol, start, wave) AS share FROM (
      SELECT v.symbol, v.start, v.wave, v.side, CASE v.side WHEN 'BUY' THEN b.buyer ELSE b.seller END AS agent, sum(b.q) AS q_, count(*) AS n_
      FROM wv v JOIN wv_b b ON b.symbol = v.symbol AND b.start = v.start AND b.trade_side = v.side AND b.idx BETWEEN v.start_idx AND coalesce(v.end_idx, v.last_idx) GROUP BY ALL)) WHERE agent <> '') WHERE rank <= 5""",
    *DAILY_WAVES,
)
add("flow_phases", lambda t: efficiency.flow_phases(t, N), f"{ID}; phase_no; phase; trades; volume; buy; sell; directed; delta; flow_direction; ~dominance; price_change; ~seconds; ~contracts_per_second; ~buy_response; ~sell_response; ~response; ~effort_vs_median; label", "FROM ph")
add("effort_events", lambda t: efficiency.effort_events(efficiency.flow_phases(t, N)), f"{ID}; phase; side=flow_direction; ~effort_vs_median; label; price_change; directed", "FROM eff")
add("efficiency_decay", lambda t: efficiency.efficiency_decay(efficiency.flow_phases(t, N)), f"{ID}; side; code='PERDA_EFICIENCIA_' || side; from_phase; to_phase; ~initial_efficiency=r0; ~final_efficiency=r1; ~efficiency_ratio; initial_volume=v0; final_volume=v1; not_collapsed=v1 >= v0 * 0.8", "FROM dec")
add(
    "flow_candle",
    lambda t: efficiency.flow_candle(t, N),
    f"{ID}; side=eside; relation=erelation; directed; price_change; range_ticks=h - l; ~seconds=sec; ~contracts_per_second=directed / sec; ~trades_per_second=trades / sec; ~ticks_per_1000=CASE WHEN directed > 0 THEN price_change * 1000.0 / directed END; ~dominant_response=CASE eside WHEN 'BUY' THEN price_change * 1000.0 / buy WHEN 'SELL' THEN price_change * -1000.0 / sell END",
    "FROM (SELECT *, greatest(1.0, (us1 - us0) / 1e6) AS sec FROM f JOIN c USING (symbol, start))",
)
SEVERITY = "CASE WHEN {0} >= 0.8 THEN 'MUITO_ALTA' WHEN {0} >= 0.6 THEN 'ALTA' WHEN {0} >= 0.4 THEN 'MODERADA' ELSE 'BAIXA' END"
add("paradox_flags", lambda t: efficiency.paradox_flags(t, N), f"{ID}; code; ~score; severity={SEVERITY.format('score')}", "FROM par")
add(
    "paradox_ranking",
    lambda t: efficiency.paradox_ranking(t, N, 20),
    f"{ID}; ~score; flags; rank; candles; paradoxical; ~share=paradoxical / candles",
    "FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(score, 12) DESC, start) AS rank, count(*) OVER (PARTITION BY symbol) AS paradoxical FROM (SELECT symbol, start, max(score) AS score, count(*) AS flags FROM par GROUP BY symbol, start)) JOIN (SELECT symbol, count(*) AS candles FROM c GROUP BY symbol) USING (symbol) WHERE rank <= 20",
)
add("paradox_scan", lambda t: efficiency.paradox_scan(t, N), f"{ID}; ~score=max(score); flags=count(*); priority={SEVERITY.format('max(score)')}", "FROM par GROUP BY symbol, start")
ZONE = "CASE WHEN h = l THEN 'CENTRO' WHEN (c - l) / (h - l) >= 0.8 THEN 'TOPO' WHEN (c - l) / (h - l) <= 0.2 THEN 'FUNDO' ELSE 'MEIO' END"
add("geometry", lambda t: interpret.geometry(t, N), f"{ID}; direction=CASE WHEN c > o THEN 'ALTA' WHEN c < o THEN 'BAIXA' ELSE 'NEUTRO' END; body_ticks=c - o; range_ticks=h - l; upper_wick_ticks=h - greatest(o, c); lower_wick_ticks=least(o, c) - l; ~body_abs_share=CASE WHEN h > l THEN abs(c - o) / (h - l) ELSE 0 END; close_zone={ZONE}", "FROM c")
EV = "CASE WHEN coverage = 0 THEN 0 ELSE 0.60 * coverage + 0.25 * identity_coverage + 0.15 * least(trades / 100.0, 1.0) END"
add("evidence_quality", lambda t: interpret.evidence_quality(t, N), f"{ID}; ~score={EV}; label=CASE WHEN coverage = 0 THEN 'INDISPONIVEL' WHEN {EV} >= 0.8 THEN 'ALTA' WHEN {EV} >= 0.6 THEN 'MODERADA' ELSE 'LIMITADA' END", "FROM f")
FACTS = """SELECT symbol, start, 'GEOMETRIA' AS code, c - o AS a, CAST(h - l AS DOUBLE) AS b, {zone} AS detail FROM c
    UNION ALL SELECT symbol, start, 'AGRESSAO_TOTAL', delta, coverage, CASE WHEN directed > 0 THEN 'true' ELSE 'false' END FROM f
    UNION ALL SELECT symbol, start, 'COMPOSICAO_AGRESSAO', buy / volume, sell / volume, NULL FROM f
    UNION ALL SELECT symbol, start, 'DIVERGENCIA_PRECO_FLUXO', price_change, delta, priority FROM f WHERE relation = 'DIVERGENTE'
    UNION ALL SELECT symbol, start, 'EFICIENCIA_FLUXO', price_change, CASE WHEN directed > 0 THEN price_change * 1000.0 / directed END, coalesce(ne, 0) || '/' || coalesce(nd, 0)
      FROM f LEFT JOIN (SELECT symbol, start, count(*) AS ne FROM eff GROUP BY ALL) e USING (symbol, start) LEFT JOIN (SELECT symbol, start, count(*) AS nd FROM dec GROUP BY ALL) d USING (symbol, start)
    UNION ALL SELECT symbol, start, 'CANDLE_PARADOXAL', max(score), count(*), {severity} FROM par GROUP BY symbol, start
    UNION ALL SELECT symbol, start, 'NIVEL_MAIS_AGREDIDO', arg_max(p, (directed, abs(delta), volume, p)), max(directed), arg_max(direction, (directed, abs(delta), volume, p)) FROM lv WHERE directed > 0 GROUP BY symbol, start
    UNION ALL SELECT symbol, start, 'AGENTE', q_, share, side || ' ' || agent FROM ar WHERE rank = 1"""
FACTS = FACTS.format(zone=ZONE, severity=SEVERITY.format("max(score)"))
add(
    "facts_with_waves",
    lambda t: interpret.facts(t, DAY_S).filter("code IN ('ULTIMO_TERMINO_ONDA', 'ONDA_ABERTA_FECHAMENTO')"),
    f"{ID}; code; ~a; ~b; detail",
    """FROM (SELECT symbol, start, 'ULTIMO_TERMINO_ONDA' AS code, arg_max(pressure_decay, wave) AS a, max(end_idx) AS b, arg_max(side || ' ' || termination, wave) AS detail FROM wv WHERE end_idx IS NOT NULL GROUP BY symbol, start
      UNION ALL SELECT symbol, start, 'ONDA_ABERTA_FECHAMENTO', start_idx, peak_qty, side FROM wv WHERE end_idx IS NULL)""",
    *DAILY_WAVES,
)
add("facts_flow", lambda t: interpret.facts(t, N, rules=None), f"{ID}; code; ~a; ~b; detail", f"FROM ({FACTS})", AGENTS.format(k="symbol, start"))
CODES = ["AGRESSAO_ALINHADA_ALTA", "AGRESSAO_ALINHADA_BAIXA", "ALTA_COM_DELTA_VENDEDOR", "BAIXA_COM_DELTA_COMPRADOR", "ESFORCO_AGRESSOR_SEM_RESULTADO", "PERDA_EFICIENCIA_FLUXO", "REJEICAO_MAXIMA", "REJEICAO_MINIMA", "ONDA_ABERTA_SUSTENTA_FECHAMENTO", "DISPUTA_EQUILIBRADA", "MUDANCA_CONTROLE_INTRABAR"]
PLACED = f"hypp AS (SELECT *, list_position({CODES!r}, code) AS place FROM {{hyp}})"
CONF = "CASE WHEN score >= 0.72 THEN 'FORTE' WHEN score >= 0.48 THEN 'MODERADA' ELSE 'FRACA' END"
add("hypotheses", lambda t: interpret.hypotheses(t, N, rules=None), f"{ID}; code; ~score; confidence={CONF}", "FROM hyp")
SYN = "FROM (SELECT *, row_number() OVER (PARTITION BY symbol, start ORDER BY round(score, 9) DESC, place) AS rank FROM hypp) GROUP BY symbol, start"
DETAIL = "symbol; start; ~open_price=round(o * 0.01, 10); ~close_price=round(c * 0.01, 10); n_levels; ~level_volume; n_phases; n_events; n_flags; n_waves; n_facts; first_hypothesis; n_timeline=k; n_path=64; range_ticks=h - l"
add(
    "candle_detail",
    lambda t: interpret.candle_detail(t, N, driver_tables.TICK).select(
        "symbol",
        "start",
        "open_price",
        "close_price",
        *[F.coalesce(F.size(x), F.lit(0)).cast("long").alias(f"n_{n}") for n, x in (("levels", "levels"), ("phases", "phases"), ("events", "events"), ("flags", "paradox"), ("waves", "waves"), ("facts", "facts"), ("timeline", "timeline"), ("path", "counterfactual"))],
        F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + x["volume"]).alias("level_volume"),
        F.try_element_at("hypotheses", F.lit(1))["code"].alias("first_hypothesis"),
        "dna.range_ticks",
    ),
    DETAIL,
    f"""FROM c JOIN (SELECT symbol, start, count(*) AS n_levels, sum(volume) AS level_volume FROM lv GROUP BY ALL) USING (symbol, start) JOIN (SELECT symbol, start, count(*) AS n_phases FROM ph GROUP BY ALL) USING (symbol, start)
      JOIN (SELECT symbol, start, count(*) FILTER (WHERE kind = 'e') AS n_events, count(*) FILTER (WHERE kind = 'p') AS n_flags, count(*) FILTER (WHERE kind = 'w') AS n_waves, count(*) FILTER (WHERE kind = 'f') AS n_facts FROM (
        SELECT symbol, start, '-' AS kind FROM c UNION ALL SELECT symbol, start, 'e' FROM eff UNION ALL SELECT symbol, start, 'e' FROM dec UNION ALL SELECT symbol, start, 'p' FROM par UNION ALL SELECT symbol, start, 'w' FROM wn
        UNION ALL SELECT symbol, start, 'f' FROM ({FACTS}) UNION ALL SELECT symbol, start, 'f' FROM wn WHERE end_idx IS NULL UNION ALL SELECT DISTINCT symbol, start, 'f' FROM wn WHERE end_idx IS NOT NULL) GROUP BY ALL) USING (symbol, start)
      LEFT JOIN (SELECT symbol, start, arg_max(code, (round(score, 9), -place)) AS first_hypothesis FROM hypp GROUP BY ALL) USING (symbol, start)""",
    AGENTS.format(k="symbol, start"),
    *SHORT_WAVES,
    queries_sql.with_waves("wn"),
    PLACED.format(hyp="hypw"),
)
add("synthesis", lambda t: interpret.synthesis(interpret.hypotheses(t, N, rules=None)), f"{ID}; first_code=max(code) FILTER (WHERE rank = 1); second_code=max(code) FILTER (WHERE rank = 2); ~best_score=max(score)", SYN, PLACED.format(hyp="hyp"))
add("hypotheses_with_waves", lambda t: interpret.hypotheses(t, N), f"{ID}; code; ~score; confidence={CONF}; rank", "FROM (SELECT *, row_number() OVER (PARTITION BY symbol, start ORDER BY round(score, 9) DESC, place) AS rank FROM hypp)", *SHORT_WAVES, queries_sql.with_waves("wn"), PLACED.format(hyp="hypw"))
add(
    "session_quality",
    lambda t: quality.session_quality(t, DAILY),
    "symbol; session_date; schedule_id='DAILY'; trades; ~p95_intertrade_seconds=p95; ~gap_threshold_seconds=thr; gap_count; ~max_gap_seconds=max_gap; ~coverage_ratio=cov; ~start_delay_seconds=delay; ~end_early_seconds=early; ~active_minute_ratio=act; ~score; status; eligible=status IN ('COMPLETE', 'LIKELY_COMPLETE') AND score >= 88",
    "FROM ql",
)
add("session_gaps_top8", lambda t: quality.session_gaps(t), "symbol; session_date; rank; from_us; to_us=us; ~seconds=g / 1e6", "FROM (SELECT *, row_number() OVER (PARTITION BY symbol, session_date ORDER BY g DESC, us) AS rank FROM ql0 JOIN ql2 USING (symbol, session_date) WHERE g / 1e6 > thr) WHERE rank <= 8")
STATUS = "CASE WHEN c.o IS NULL THEN 'NO_DATA' WHEN c.o <> refs.o OR c.h <> refs.h OR c.l <> refs.l OR c.c <> refs.c THEN 'MISMATCH' WHEN c.v <> refs.v THEN 'OHLC_MATCH' ELSE 'EXACT' END"
RC = f"rc AS (SELECT refs.symbol, refs.start, {STATUS} AS status, c.h - refs.h AS high_delta, c.v - refs.v AS volume_delta FROM refs LEFT JOIN c USING (symbol, start))"
add("reconcile_status", lambda t, r: reconcile.reconcile(t, r, N), f"{ID}; status; high_delta; volume_delta", "FROM rc", RC)
COUNTS = "; ".join(f"{k}=count(*) FILTER (WHERE status = '{k.upper()}')" for k in ("exact", "ohlc_match", "mismatch", "no_data"))
add("reconcile_summary", lambda t, r: reconcile.reconcile_summary(reconcile.reconcile(t, r, N)), f"symbol; references=count(*); {COUNTS}; ~exact_rate=count(*) FILTER (WHERE status = 'EXACT') / count(*) FILTER (WHERE status <> 'NO_DATA'); ~ohlc_match_rate=count(*) FILTER (WHERE status IN ('EXACT', 'OHLC_MATCH')) / count(*) FILTER (WHERE status <> 'NO_DATA')", "FROM rc GROUP BY symbol", RC)
add("reconcile_islands", lambda t, r: reconcile.reconcile_available(t, r, N), f"{ID}; status", "FROM rc WHERE status <> 'NO_DATA'", RC)
add(
    "reconcile_window",
    lambda t, r: reconcile.reconcile_window(t, r, N),
    f"{ID}; status",
    f"""FROM (SELECT symbol, start, CASE WHEN start > s0 AND start < s1 THEN status WHEN start = s0 AND start < s1 THEN CASE WHEN u0 - start * 1000000 <= 5000000 THEN status ELSE 'PARTIAL_SOURCE_WINDOW' END
      WHEN start = s1 THEN CASE WHEN u1 - start * 1000000 >= {(N - 5) * 1000000} THEN status ELSE 'PARTIAL_SOURCE_WINDOW' END ELSE 'PARTIAL_SOURCE_WINDOW' END AS status
      FROM rc JOIN (SELECT symbol, min(us) AS u0, max(us) AS u1, min(start) AS s0, max(start) AS s1 FROM t GROUP BY symbol) USING (symbol)
      WHERE (start + {N}) * 1000000 > u0 AND start * 1000000 <= u1)""",
    RC,
)
RX = f"{ID}; session_date; direction; ~body_share; ~upper_wick_share; ~lower_wick_share; ~volatility_ratio; volatility_bucket; session_regime; ~session_directional_efficiency=session_eff; ~session_net_to_range=session_ntr; regime_short; regime_medium; regime_to_date; opening_gap_ticks=gap; ~opening_gap_ratio=r; opening_gap_bucket=bucket; ~directional_efficiency; high_first"
add("research_index", lambda t: research.research_index(t, N, DAILY), RX, "FROM rx")


def _refreshed(t: DataFrame) -> DataFrame:
    """The stored research index after two imports, each followed by a refresh: days up to the 24th without the 9th and every fiftieth trade of
    the 12th, and then all trades that are left."""
    day = lambda d: F.lit(f"2024-01-{d:02}").cast("date")
    early = (F.col("session_date") <= day(24)) & (F.col("session_date") != day(9)) & ((F.col("session_date") != day(12)) | (F.col("sequence_no") % 50 != 0))
    held = store.Store(t.sparkSession, f"{shared_folder(t.sparkSession)}/store-{uuid.uuid4().hex}")
    table = derived.index_table(DAILY)
    for part in (t.filter(early), t.filter(~early)):
        held.add_trades(part)
        derived.refresh(held, table, N)
    return derived.read(held, table, N)


add("index_refresh", _refreshed, RX, "FROM rx")
add("rolling_regime", lambda t: research.research_index(t, N, DAILY), f"{ID}; regime_short; regime_medium; regime_to_date", "FROM rx")
add("volatility_bucket", lambda t: research.research_index(t, N, DAILY), f"{ID}; ~volatility_ratio; volatility_bucket", "FROM rx")
add("opening_gap", lambda t: research.opening_gaps(research.with_session(candles.build_candles(t, N))), "symbol; session_date; opening_gap_ticks=gap; ~opening_gap_ratio=r; opening_gap_bucket=bucket", "FROM og")
LOG = "least(abs(ln(({0}.{2} + 1.0) / ({1}.{2} + 1.0))) / 2, 1.0)"


def _index_and_target(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The research index, and of it the first candle of the library's tenth day."""
    index = research.research_index(t, N, DAILY)
    return index, index.filter((F.col("symbol") == "SYM0") & (F.col("session_date") == F.lit("2024-01-10").cast("date"))).orderBy("start")


def _similar(kind: str) -> Callable[[DataFrame], DataFrame]:
    return lambda t: research.similar(*_index_and_target(t), kind, 20)


def _similar_sql(weights: dict[str, float], aggression_weight: float | None) -> str:
    total = sum(weights.values())
    weighted = " + ".join(f"({e}) * {w}" for e, w in weights.items())
    distance = f"({weighted}) / {total!r}"
    if aggression_weight:
        distance = f"CASE WHEN a.aggression_imbalance IS NULL OR x.aggression_imbalance IS NULL THEN {distance} ELSE ({weighted} + abs(a.aggression_imbalance - x.aggression_imbalance) / 2 * {aggression_weight}) / {total + aggression_weight!r} END"
    return f"""FROM (SELECT x.symbol, x.start, round(greatest(0.0, least(100.0, (1 - round({distance}, 9)) * 100)), 1) AS score
      FROM rx x, (SELECT * FROM rx WHERE symbol = 'SYM0' AND session_date = date '2024-01-10' ORDER BY start LIMIT 1) a
      WHERE x.session_date <> a.session_date ORDER BY score DESC, x.start, x.symbol LIMIT 20)"""


gap = lambda c: f"abs(a.{c} - x.{c})"
log = lambda c: LOG.format("a", "x", c)
other = lambda c: f"CASE WHEN a.{c} = x.{c} THEN 0.0 ELSE 1.0 END"
VISUAL = {"CASE WHEN a.direction = x.direction THEN 0.0 WHEN 'DOJI' IN (a.direction, x.direction) THEN 0.45 ELSE 1.0 END": 1.3, gap("body_share"): 1.35, gap("upper_wick_share"): 1.0, gap("lower_wick_share"): 1.0, gap("close_location"): 0.55, log("range_ticks"): 0.25}
LIKE_DNA = {gap("directional_efficiency"): 1.15, gap("range_efficiency"): 0.95, gap("reversal_rate"): 0.9, f"least({gap('revisit_rate')}, 1.0)": 0.8, other("high_first"): 0.65, gap("upper_third_volume_share"): 0.45, gap("lower_third_volume_share"): 0.45, log("path_distance_ticks"): 0.55, log("trades"): 0.45, log("volume"): 0.35, log("trades_per_second"): 0.5}
STRUCTURAL = {f"{gap('body_to_range')} / 2": 1.25, gap("close_location"): 0.8, gap("directional_efficiency"): 1.0, gap("range_efficiency"): 1.0, gap("reversal_rate"): 0.8, f"least({gap('revisit_rate')}, 1.0)": 0.7, gap("upper_third_volume_share"): 0.45, gap("lower_third_volume_share"): 0.45, log("range_ticks"): 0.55, log("trades"): 0.4, log("volume"): 0.35, other("high_first"): 0.55}
add(
    "similar_excluded",
    lambda t: research.low_quality(*_index_and_target(t)),
    "looked_at; excluded_low_quality; target_eligible",
    """FROM (SELECT count(*) AS looked_at, count(*) FILTER (WHERE NOT good) AS excluded_low_quality, (SELECT bool_and(status IN ('COMPLETE', 'LIKELY_COMPLETE') AND score >= 88) FROM ql WHERE symbol = 'SYM0' AND session_date = date '2024-01-10') AS target_eligible
      FROM (SELECT rx.*, status IN ('COMPLETE', 'LIKELY_COMPLETE') AND score >= 88 AS good FROM rx JOIN ql USING (symbol, session_date)) WHERE session_date <> date '2024-01-10')""",
)
add("similar_visual", _similar("visual"), f"{ID}; ~score", _similar_sql(VISUAL, None))
add("similar_dna", _similar("dna"), f"{ID}; ~score", _similar_sql(LIKE_DNA, 0.7))
add("similar_structural", _similar("structural"), f"{ID}; ~score", _similar_sql(STRUCTURAL, 0.65))
PATH = f"""xy AS (SELECT symbol, start, idx, least(1.0, greatest(0.0, (us - start * 1000000) / ({N} * 1e6))) AS x, CASE WHEN hi > lo THEN (p - lo) / (hi - lo) ELSE 0.5 END AS y FROM b),
xz AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x1 FROM (SELECT symbol, start, x, arg_max(y, idx) AS y FROM xy GROUP BY ALL) WINDOW w AS (PARTITION BY symbol, start ORDER BY x)),
grid AS (SELECT k.k AS point, k.k / 24.0 AS px FROM range(25) k(k))"""
add(
    "trajectory_path",
    lambda t: trajectory.trajectory_path(t, N),
    f"{ID}; point=CAST(point AS INTEGER); ~y=CASE WHEN x0 IS NULL OR px >= x THEN y ELSE y0 + (y - y0) * ((px - x0) / (x - x0)) END",
    "FROM xz JOIN grid ON (x0 IS NULL OR px > x0) AND (x1 IS NULL OR px <= x)",
    PATH,
)
add(
    "compare_paths",
    lambda t: research.compare(t, N, ("SYM0", 1_704_844_800), ("SYM1", 1_705_017_600)),
    "point=CAST(point AS INTEGER); ~first_y; ~second_y; ~difference=abs(first_y - second_y)",
    """FROM (SELECT point, max(y) FILTER (WHERE symbol = 'SYM0') AS first_y, max(y) FILTER (WHERE symbol = 'SYM1') AS second_y FROM (
      SELECT symbol, start, point, CASE WHEN x0 IS NULL OR px >= x THEN y ELSE y0 + (y - y0) * ((px - x0) / (x - x0)) END AS y
      FROM xz JOIN grid ON (x0 IS NULL OR px > x0) AND (x1 IS NULL OR px <= x))
      WHERE symbol = 'SYM0' AND start = 1704844800 OR symbol = 'SYM1' AND start = 1705017600 GROUP BY point)""",
    PATH,
)
add("rule_family", lambda t: trajectory.rule_family(t, N), f"{ID}; family; ~confidence", "FROM famx")
add("family_share", lambda t: trajectory.family_share(trajectory.rule_family(t, N)), "symbol; family; count=n_; ~share=n_ / sum(n_) OVER (PARTITION BY symbol)", "FROM (SELECT symbol, family, count(*) AS n_ FROM famx GROUP BY ALL)")
add(
    "eligible_families",
    lambda t: trajectory.eligible_families(trajectory.rule_family(t, N), research.research_index(t, N, DAILY)),
    f"{ID}; family",
    "FROM famx WHERE NOT EXISTS (SELECT 1 FROM ql WHERE ql.symbol = famx.symbol AND ql.session_date = famx.session_date AND NOT (status IN ('COMPLETE', 'LIKELY_COMPLETE') AND score >= 88))",
)
add("kmeans_clusters", lambda t: trajectory.kmeans(trajectory.signatures(t, N))[0], f"{ID}; cluster; ~distance", "FROM km", *queries_sql.clusters(PATH))
add("cluster_summary", lambda t: trajectory.cluster_summary(trajectory.kmeans(trajectory.signatures(t, N))[0], trajectory.rule_family(t, N)), "cluster; size; ~cohesion; dominant_rule; ~dominance=n_ / size; medoid_symbol=m.symbol; medoid_start=m.start",
    """FROM (SELECT cluster, count(*) AS size, avg(distance) AS cohesion, arg_min({'symbol': symbol, 'start': start}, (distance, start, symbol)) AS m FROM km GROUP BY cluster)
      JOIN (SELECT cluster, arg_max(family, (n, -s_)) AS dominant_rule, max(n) AS n_ FROM (SELECT cluster, family, count(*) AS n, min(start) AS s_ FROM km JOIN famx USING (symbol, start) GROUP BY ALL) GROUP BY cluster) USING (cluster)""",
    *queries_sql.clusters(PATH),
)
add("transitions", lambda t: transitions.transitions(trajectory.rule_family(t, N), N), "symbol; from_family=family; to_family=f1; count=n_; ~probability=n_ / sum(n_) OVER (PARTITION BY symbol, family)", "FROM (SELECT symbol, family, f1, count(*) AS n_ FROM nx WHERE f1 IS NOT NULL GROUP BY ALL)")
add("motifs", lambda t: transitions.motifs(trajectory.rule_family(t, N), N), "symbol; first=family; second=f1; third=f2; count=n_; rank", "FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n_ DESC, s_, family, f1, f2) AS rank FROM (SELECT symbol, family, f1, f2, count(*) AS n_, min(start) AS s_ FROM nx WHERE f2 IS NOT NULL GROUP BY ALL)) WHERE rank <= 12")
add("sequence_neighbours", lambda t: transitions.neighbours(trajectory.rule_family(t, N), N), f"{ID}; previous=CASE WHEN lag(start) OVER w = start - {N} THEN lag(family) OVER w END; family; next=f1", "FROM nx WINDOW w AS (PARTITION BY symbol, session_date ORDER BY start)")
HOUR = "start % 86400 // 3600"
DAYPART = f"CASE WHEN {HOUR} < 11 THEN 'MANHA_INICIAL' WHEN {HOUR} < 14 THEN 'MEIO_DO_DIA' WHEN {HOUR} < 17 THEN 'TARDE' ELSE 'FECHAMENTO' END"
add(
    "family_distributions",
    lambda t: transitions.distributions(trajectory.rule_family(t, N), research.research_index(t, N, DAILY)),
    "symbol; family; kind; value; count=count(*)",
    f"FROM (SELECT symbol, family, unnest(['hour', 'daypart', 'month', 'volatility', 'context_regime', 'session_regime']) AS kind, unnest([printf('%02dh', {HOUR}), {DAYPART}, strftime(famx.session_date, '%Y-%m'), volatility_bucket, regime_medium, session_regime]) AS value FROM famx JOIN rx USING (symbol, start)) GROUP BY symbol, family, kind, value",
)
STAB = f"""sr AS (SELECT famx.symbol, family, famx.session_date, {DAYPART.replace('start', 'famx.start')} AS daypart, volatility_bucket, regime_medium FROM famx JOIN rx USING (symbol, start)),
en AS (SELECT symbol, family, kind, CASE WHEN count(*) > 1 THEN -sum(n / tot * ln(n / tot)) / ln(count(*)) ELSE 0 END AS e FROM (
  SELECT *, sum(n) OVER (PARTITION BY symbol, family, kind) AS tot FROM (SELECT symbol, family, kind, value, count(*) AS n FROM (
    SELECT symbol, family, unnest(['d', 'v', 'm']) AS kind, unnest([daypart, volatility_bucket, regime_medium]) AS value FROM sr) GROUP BY ALL)) GROUP BY ALL),
ss AS (SELECT symbol, session_date, count(*) AS tot FROM sr GROUP BY ALL),
sf AS (SELECT g.symbol, g.family, ss.session_date, coalesce(n, 0) / tot AS share, coalesce(n, 0) AS n FROM (SELECT DISTINCT symbol, family FROM sr) g JOIN ss USING (symbol)
  LEFT JOIN (SELECT symbol, family, session_date, count(*) AS n FROM sr GROUP BY ALL) x ON x.symbol = g.symbol AND x.family = g.family AND x.session_date = ss.session_date),
sg AS (SELECT symbol, family, CAST(sum(n) AS BIGINT) AS cnt, count(*) FILTER (WHERE n > 0) AS sessions, count(*) FILTER (WHERE n > 0) / count(*) AS prevalence, avg(share) AS mean, stddev_pop(share) AS sd FROM sf GROUP BY ALL),
sh AS (SELECT sg.*, greatest(0.0, 1 - least(sd / greatest(mean, 0.05), 1.0)) AS cons, spread, cnt / sum(cnt) OVER (PARTITION BY symbol) AS share FROM sg JOIN (SELECT symbol, family, sum(e) / 3 AS spread FROM en GROUP BY ALL) USING (symbol, family)),
si AS (SELECT *, round(round(100 * (0.45 * prevalence + 0.35 * cons + 0.20 * spread), 6), 1) AS score FROM sh)"""
add(
    "stability",
    lambda t: transitions.stability(trajectory.rule_family(t, N), research.research_index(t, N, DAILY)),
    "symbol; family; count=cnt; ~share; sessions; ~prevalence; ~mean_session_share=mean; ~session_share_std=sd; ~consistency=cons; ~context_spread=spread; ~score; label=CASE WHEN cnt < 5 THEN 'AMOSTRA_PEQUENA' WHEN score >= 70 THEN 'DISTRIBUIDA' WHEN score >= 45 THEN 'MODERADA' ELSE 'CONCENTRADA' END",
    "FROM si",
    STAB,
)
add("validation_exclusions", lambda t, r: validation.exclusions(validation.gated(t, N, r)), "symbol; reason; candles=count(*)", "FROM (SELECT c.symbol, CASE WHEN refs.o IS NULL THEN 'NO_REFERENCE' WHEN c.o <> refs.o OR c.h <> refs.h OR c.l <> refs.l OR c.c <> refs.c OR c.v <> refs.v THEN 'REFERENCE_MISMATCH' ELSE 'ELIGIBLE' END AS reason FROM c LEFT JOIN refs USING (symbol, start)) GROUP BY symbol, reason")
add("direction_baseline", lambda t, r: validation.direction_baseline(validation.gated(t, N, r), N, HORIZONS), "symbol; horizon; eligible; up; down; flat=eligible - up - down; ~up_rate=up / eligible; ~down_rate=down / eligible", "FROM bl")
OUT = """hx AS (SELECT hyp.*, CASE WHEN code IN ('AGRESSAO_ALINHADA_ALTA', 'ALTA_COM_DELTA_VENDEDOR', 'REJEICAO_MINIMA') THEN 'UP' WHEN code IN ('AGRESSAO_ALINHADA_BAIXA', 'BAIXA_COM_DELTA_COMPRADOR', 'REJEICAO_MAXIMA') THEN 'DOWN'
  WHEN code = 'MUDANCA_CONTROLE_INTRABAR' THEN CASE WHEN fd > 0 THEN 'UP' ELSE 'DOWN' END END AS way FROM hyp LEFT JOIN (SELECT symbol, start, arg_max(delta, phase_no) AS fd FROM ph GROUP BY ALL) USING (symbol, start)),
ho AS (SELECT hx.symbol, code, horizon, way, CASE WHEN score >= 0.72 THEN 'FORTE' WHEN score >= 0.48 THEN 'MODERADA' ELSE 'FRACA' END AS confidence, score, CASE way WHEN 'UP' THEN delta ELSE -delta END AS al,
  CASE way WHEN 'UP' THEN ah.up ELSE ah.down END AS fav, CASE way WHEN 'UP' THEN ah.down ELSE ah.up END AS adv FROM hx JOIN ah USING (symbol, start) WHERE way IS NOT NULL),
hg AS (SELECT symbol, code, horizon, way, confidence, count(*) AS n, count(*) FILTER (WHERE al > 0) AS hits, count(*) FILTER (WHERE al >= 2) AS two, avg(al) AS mal, avg(fav) AS mfav, avg(adv) AS madv, avg(score) AS msc
  FROM ho GROUP BY GROUPING SETS ((symbol, code, horizon, way), (symbol, code, horizon, way, confidence))),
hb AS (SELECT hg.*, CASE way WHEN 'UP' THEN bl.up ELSE bl.down END / eligible AS base, 3.841458820694124 AS z2 FROM hg JOIN bl USING (symbol, horizon))"""
WIL = "(hits / n + z2 / (2 * n) {0} sqrt(z2) * sqrt((hits / n * (1 - hits / n) + z2 / (4 * n)) / n)) / (1 + z2 / n)"
add(
    "hypothesis_outcomes",
    lambda t, r: validation.hypothesis_outcomes(t, N, HORIZONS, r, rules=None),
    f"symbol; code; horizon; way; confidence; n; hits; two_tick_hits=two; ~hit_rate=hits / n; ~wilson_low=greatest(0.0, {WIL.format('-')}); ~wilson_high=least(1.0, {WIL.format('+')}); ~baseline_rate=base; ~lift_points=(hits / n - base) * 100; sample_status=CASE WHEN n < 30 THEN 'AMOSTRA_INSUFICIENTE' WHEN n < 100 THEN 'EXPLORATORIA' WHEN n < 500 THEN 'PRELIMINAR' ELSE 'AMOSTRA_MAIOR' END; ~mean_aligned=mal; ~mean_favorable=mfav; ~mean_adverse=madv; ~mean_score=msc",
    "FROM hb",
    OUT,
)
add("hypothesis_outcomes_with_waves", lambda t, r: validation.hypothesis_outcomes(t, N, HORIZONS, r), f"symbol; code; horizon; way; confidence; n; hits; ~hit_rate=hits / n; ~wilson_low=greatest(0.0, {WIL.format('-')}); ~wilson_high=least(1.0, {WIL.format('+')}); ~lift_points=(hits / n - base) * 100",
    "FROM hb",
    *SHORT_WAVES,
    queries_sql.with_waves("wn"),
    OUT.replace("hyp.*", "hypw.*").replace("FROM hyp LEFT", "FROM hypw LEFT").replace("  WHEN code = 'MUDANCA", "  WHEN code = 'ONDA_ABERTA_SUSTENTA_FECHAMENTO' THEN CASE open_side WHEN 'BUY' THEN 'UP' ELSE 'DOWN' END WHEN code = 'MUDANCA"),
)
add("counterfactual_paths", lambda t: simulate.path_checks(candles.build_candles(t, N)), f"{ID}; points=64; from_open=true; to_close=true; up_to_high=true; down_to_low=true; label='SIMULATED'", "FROM c")
add(
    "import_diagnostics",
    lambda t: csv_trades.import_diagnostics(t, "sequence_no"),
    "symbol; rows=count(*); source_order=CASE WHEN count(*) FILTER (WHERE dn) > 0 AND count(*) FILTER (WHERE up) = 0 THEN 'DESCENDING' WHEN count(*) FILTER (WHERE dn) = 0 AND count(*) FILTER (WHERE up) > 0 THEN 'ASCENDING' WHEN count(*) FILTER (WHERE dn) = 0 THEN 'SAME_TIMESTAMP' ELSE 'MIXED' END; inversions=count(*) FILTER (WHERE dn); repeated_trade_ids=0; ~known_share=count(*) FILTER (WHERE side <> 'NONE') / count(*); ~agents_share=count(*) FILTER (WHERE buyer <> '' AND seller <> '') / count(*); rlp=count(*) FILTER (WHERE rlp)",
    "FROM (SELECT *, us > lag(us) OVER w AS up, us < lag(us) OVER w AS dn FROM t WINDOW w AS (PARTITION BY symbol ORDER BY seq)) GROUP BY symbol",
)
add("minute_index", lambda t: csv_trades.minute_index(t, 15, "sequence_no"), "symbol; start=us // 900000000 * 900; first_row=min(seq); last_row=max(seq); trades=count(*); open_row=arg_min(seq, (us, seq)); close_row=arg_max(seq, (us, seq))", "FROM t GROUP BY symbol, us // 900000000 * 900")


def _imports(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two overlapping exports: days up to the 18th, where small trades lack side and agents, and days from the 12th on."""
    keyed = t.withColumn("event_key", store.trade_key())
    poor = F.col("quantity") < 8
    first = keyed.filter(F.col("session_date") <= F.lit("2024-01-18").cast("date")).withColumns({"aggressor": F.when(poor, "NONE").otherwise(F.col("aggressor")), "buyer_id": F.when(poor, "").otherwise(F.col("buyer_id")), "seller_id": F.when(poor, "").otherwise(F.col("seller_id")), "flags": F.when(~poor, F.col("flags"))})
    return first, keyed.filter(F.col("session_date") >= F.lit("2024-01-12").cast("date"))


FIRST, BOTH = "session_date < date '2024-01-12'", "session_date BETWEEN date '2024-01-12' AND date '2024-01-18'"
add("dedupe_insert", lambda t: store.new_rows(*_imports(t), "event_key"), "symbol; sequence_no=seq; price_ticks=p; quantity=q", "FROM t WHERE session_date > date '2024-01-18'")
add(
    "enrich_merge",
    lambda t: store.enriched(*_imports(t)),
    f"symbol; sequence_no=seq; aggressor=CASE WHEN {FIRST} AND q < 8 THEN 'NONE' ELSE side END; buyer_id=CASE WHEN {FIRST} AND q < 8 THEN '' ELSE buyer END; change=CASE WHEN session_date > date '2024-01-18' THEN 'inserted' WHEN {BOTH} AND q < 8 AND (side <> 'NONE' OR buyer <> '' OR rlp) THEN 'enriched' ELSE 'kept' END",
    "FROM t",
)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades, with agents that hold quotes, separators and backslashes, written as headerless CSV and read again."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    odd = lambda c: F.when(F.col(c) != "", F.concat(F.lit('"'), c, F.lit('", \\ S"A'))).otherwise("")
    store.export_csv(driver_tables.trades(spark, sf_dir).withColumns({c: odd(c) for c in ("buyer_id", "seller_id")}), path, driver_tables.TICK, trade_ids=True)
    t = csv_trades.trades_or_error(csv_trades.read_trades(spark, path, tick_size=driver_tables.TICK))
    return t.select("symbol", micros(t).alias("us"), "session_date", "price_ticks", "quantity", "trade_id", "aggressor", "buyer_id", "seller_id", F.coalesce(is_rlp(), F.lit(False)).alias("rlp"))


QUERIES["csv_roundtrip"] = csv_roundtrip
SQL["csv_roundtrip"] = sql("SELECT symbol, us, session_date, p AS price_ticks, q AS quantity, CAST(seq AS VARCHAR) AS trade_id, side AS aggressor, CASE WHEN buyer <> '' THEN '\"' || buyer || '\", \\ S\"A' END AS buyer_id, CASE WHEN seller <> '' THEN '\"' || seller || '\", \\ S\"A' END AS seller_id, rlp FROM t")
TURNS = "(SELECT count(*) FILTER (WHERE us > b) AS up, count(*) FILTER (WHERE us < b) AS dn FROM (SELECT us, lag(us) OVER (ORDER BY seq) AS b FROM t))"
add("source_probe", lambda t: csv_trades.source_probe(t, order="sequence_no"), "rows; symbols; symbol; source_order; problem='more than one symbol'", f"FROM (SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(symbol) AS symbol FROM t), LATERAL (SELECT CASE WHEN dn > 0 AND up = 0 THEN 'DESCENDING' WHEN dn = 0 AND up > 0 THEN 'ASCENDING' WHEN dn = 0 THEN 'SAME_TIMESTAMP' ELSE 'MIXED' END AS source_order FROM {TURNS})")
add(
    "locate_candles",
    lambda t, r: csv_trades.locate_candles(csv_trades.minute_index(t, 1, "sequence_no"), r, N),
    "symbol; start; first_row; last_row; open_row; close_row; trades; status",
    "FROM (SELECT refs.symbol, refs.start, min(seq) AS first_row, max(seq) AS last_row, arg_min(seq, (us, seq)) AS open_row, arg_max(seq, (us, seq)) AS close_row, count(seq) AS trades, CASE WHEN count(seq) > 0 THEN 'FOUND' ELSE 'NO_TRADES' END AS status FROM refs LEFT JOIN t ON t.symbol = refs.symbol AND t.start = refs.start GROUP BY ALL)",
)
add("locate_interval", lambda t: csv_trades.locate_interval(csv_trades.minute_index(t, 1, "sequence_no"), 1_705_312_800, 1_705_399_200), "symbol; first_row; last_row; open_row; close_row; trades; minutes", "FROM (SELECT symbol, min(seq) AS first_row, max(seq) AS last_row, arg_min(seq, (us, seq)) AS open_row, arg_max(seq, (us, seq)) AS close_row, count(*) AS trades, count(DISTINCT us // 60000000) AS minutes FROM t WHERE us >= 1705312800000000 AND us < 1705399200000000 GROUP BY symbol)")
add(
    "wave_gap_overlap",
    lambda t: intervals.wave_gap_overlap(t, DAY_S, 600),
    f"{ID}; wave; side; gap_from; gap_to; overlap_us=CAST(least(u1, gap_to) - greatest(u0, gap_from) AS BIGINT)",
    """FROM (SELECT wv.symbol, wv.start, wave, side, a.us AS u0, z.us AS u1 FROM wv JOIN tt a ON a.symbol = wv.symbol AND a.ds = wv.start AND a.i = start_idx JOIN tt z ON z.symbol = wv.symbol AND z.ds = wv.start AND z.i = coalesce(end_idx, last_idx)) w
      JOIN (SELECT symbol, lag(us) OVER (PARTITION BY symbol, session_date ORDER BY us) AS gap_from, us AS gap_to FROM (SELECT DISTINCT symbol, session_date, us FROM t)) g USING (symbol)
      WHERE gap_to - gap_from > 600000000 AND gap_from < u1 AND u0 < gap_to""",
    *DAILY_WAVES,
    "tt AS (SELECT symbol, us, us // 86400000000 * 86400 AS ds, row_number() OVER (PARTITION BY symbol, us // 86400000000 ORDER BY us, seq) - 1 AS i FROM t)",
)
CALIBRATED = OUT.replace("ho AS (SELECT hx.symbol, code", f"ho AS (SELECT hx.symbol, {queries_sql.DAY} AS d, code", 1) + """,
cb AS (SELECT symbol, code, horizon, d, CAST(least(floor(score * 20 + 1e-9), 19) AS INTEGER) AS bin, count(*) AS n, count(*) FILTER (WHERE al > 0) AS hits FROM ho GROUP BY ALL),
cp AS (SELECT k.symbol, k.code, k.horizon, k.d, p.bin, sum(p.n) AS n, sum(p.hits) AS hits FROM (SELECT DISTINCT symbol, code, horizon, d FROM cb) k JOIN cb p ON p.symbol = k.symbol AND p.code = k.code AND p.horizon = k.horizon AND p.d < k.d GROUP BY ALL),
cr AS (SELECT symbol, code, horizon, d, a.a, z.z, sum(hits) / sum(n) AS m FROM cp, range(20) a(a), range(20) z(z) WHERE bin BETWEEN a.a AND z.z GROUP BY ALL),
cf AS (SELECT symbol, code, horizon, d, i AS bin, max(m) AS fit FROM (SELECT symbol, code, horizon, d, i.i, a, min(m) AS m FROM cr, range(20) i(i) WHERE a <= i.i AND i.i <= z GROUP BY ALL) GROUP BY ALL),
cs AS (SELECT symbol, code, horizon, d, sum(n) AS seen FROM cp GROUP BY ALL)"""
add(
    "calibrated_hypotheses",
    lambda t, r: validation.calibrated_hypotheses(t, N, HORIZONS, r, rules=None),
    "symbol; code; horizon; session_date=d; bin; n; hits; ~calibrated=fit; seen=CAST(coalesce(seen, 0) AS BIGINT)",
    "FROM cb LEFT JOIN cf USING (symbol, code, horizon, d, bin) LEFT JOIN cs USING (symbol, code, horizon, d)",
    CALIBRATED,
)
HHI = "sum(q_ * q_) FILTER (WHERE agent <> '') / (sum(q_) FILTER (WHERE agent <> '') * sum(q_) FILTER (WHERE agent <> ''))"
SHARED = f"agents=count(*) FILTER (WHERE agent <> ''); quantity=CAST(sum(q_) AS BIGINT); ~hhi={HHI}; ~effective_agents=1 / ({HHI}); ~top_share=max(q_) FILTER (WHERE agent <> '') / sum(q_) FILTER (WHERE agent <> ''); ~named_share=sum(q_) FILTER (WHERE agent <> '') / sum(q_)"
for by, key in (("", ""), ("_by_level", ", p")):
    add(
        f"agent_concentration{by}",
        (lambda t: agents.concentration(t, N, True)) if by else lambda t: agents.concentration(t, N),
        f"{ID}; {'price_ticks=p; ' if by else ''}side; {SHARED}",
        f"FROM ag GROUP BY symbol, start{key}, side HAVING count(*) FILTER (WHERE agent <> '') > 0",
        AGENTS.format(k=f"symbol, start{key}"),
    )
add(
    "agent_profiles",
    lambda t: agents.profile_matches(t, N, 4000, 2),
    "symbol; session_date; next_date; agent; match=agent2; common; ~similarity=sim; same_agent=agent = agent2",
    "FROM (SELECT a.symbol, a.session_date, a.next_date, a.agent, z.agent AS agent2, count(*) AS common, count(*) / (any_value(a.size) + any_value(z.size) - count(*)) AS sim FROM pj a JOIN pj z ON z.symbol = a.symbol AND z.session_date = a.next_date AND z.item = a.item GROUP BY ALL) WHERE sim >= 0.5",
    """pi AS (SELECT DISTINCT symbol, session_date, CASE side WHEN 'BUY' THEN buyer ELSE seller END AS agent, (floor(p / 4000.0), least((us - start * 1000000) * 2 // 14400000000, 1), side) AS item FROM t WHERE side <> 'NONE' AND CASE side WHEN 'BUY' THEN buyer ELSE seller END <> ''),
pn AS (SELECT symbol, session_date, lead(session_date) OVER (PARTITION BY symbol ORDER BY session_date) AS next_date FROM (SELECT DISTINCT symbol, session_date FROM pi)),
pj AS (SELECT pi.*, next_date, count(*) OVER (PARTITION BY pi.symbol, pi.session_date, agent) AS size FROM pi JOIN pn USING (symbol, session_date))""",
)


def _live(t: DataFrame) -> DataFrame:
    """Candles of a stream of two parts, of which the second has trades that are late by days; late ones are put aside and absorbed."""
    spark = t.sparkSession
    folder = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    held = store.Store(spark, f"{folder}/store")
    late = F.col("sequence_no") % 10 == 3
    for part in (t.filter(~late), t.filter(late)):
        part.write.mode("append").parquet(f"{folder}/in")
        streaming_live.live(spark.readStream.schema(t.schema).parquet(f"{folder}/in"), held, f"{folder}/checkpoint", N).awaitTermination()
    streaming_live.absorb(held, N)
    streaming_live.close(held, N)
    return held.read("live_candles")


add("live_candles", _live, f"{ID}; {OHLC}", "FROM c")


def _loaded(t: DataFrame) -> DataFrame:
    """The trades after a bulk load, by blocks, of their export."""
    spark = t.sparkSession
    folder = f"{shared_folder(spark)}/bulk-{uuid.uuid4().hex}"
    store.export_csv(t, f"{folder}/csv", driver_tables.TICK, trade_ids=True)
    held = store.Store(spark, f"{folder}/store")
    held.load_file(f"{folder}/csv", tick_size=driver_tables.TICK)
    return held.read("trades").withColumn("us", micros(t))


add("bulk_load", _loaded, "symbol; us; session_date; price_ticks=p; quantity=q; trade_id=CAST(seq AS VARCHAR); aggressor=side; sequence_no=row_number() OVER (ORDER BY us, seq)", "FROM t")
