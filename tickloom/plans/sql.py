"""SQL that gives the queries' rows from the same tables, written independently of the operators."""

from __future__ import annotations

N = 14_400
ID = "symbol, start"
DAY = "date '1970-01-01' + CAST(start // 86400 AS INTEGER)"

HYPOTHESES = """hyp AS (
  SELECT c.symbol, c.start, x.code, x.score FROM c JOIN f USING (symbol, start)
  JOIN (SELECT symbol, start, arg_min(way, phase_no) AS w0, arg_max(way, phase_no) AS w1, count(*) AS np FROM (
        SELECT symbol, start, phase_no, CASE WHEN directed = 0 THEN '-' WHEN dominance < 0.15 THEN '=' WHEN delta > 0 THEN 'COMPRA' ELSE 'VENDA' END AS way FROM ph) GROUP BY ALL) e USING (symbol, start)
  LEFT JOIN (SELECT symbol, start, max(effort_vs_median) AS effort FROM eff GROUP BY ALL) ef USING (symbol, start)
  LEFT JOIN (SELECT symbol, start, min(CASE WHEN efficiency_ratio = 0 THEN 1 ELSE efficiency_ratio END) AS fall FROM dec GROUP BY ALL) de USING (symbol, start)
  LEFT JOIN (SELECT lv.symbol, lv.start, bool_or(h - p <= 1) AS nh, bool_or(p - l <= 1) AS nl FROM lv JOIN c USING (symbol, start) WHERE response = 'POSSIVEL_ABSORCAO' GROUP BY ALL) ab USING (symbol, start),
  LATERAL (SELECT h - l AS sp, coalesce(abs(delta) / nullif(directed, 0), 0) AS st, CASE WHEN h = l THEN 'CENTRO' WHEN (c.c - l) / (h - l) >= 0.8 THEN 'TOPO' WHEN (c.c - l) / (h - l) <= 0.2 THEN 'FUNDO' ELSE 'MEIO' END AS zone) g,
  LATERAL (
    SELECT 'AGRESSAO_ALINHADA_ALTA' AS code, 0.35 + 0.30 * st + 0.20 * coverage + CASE WHEN zone = 'TOPO' THEN 0.12 ELSE 0 END AS score WHERE c.c > o AND delta > 0
    UNION ALL SELECT 'AGRESSAO_ALINHADA_BAIXA', 0.35 + 0.30 * st + 0.20 * coverage + CASE WHEN zone = 'FUNDO' THEN 0.12 ELSE 0 END WHERE c.c < o AND delta < 0
    UNION ALL SELECT 'ALTA_COM_DELTA_VENDEDOR', 0.38 + 0.25 * st + 0.18 * coverage WHERE c.c > o AND delta < 0
    UNION ALL SELECT 'BAIXA_COM_DELTA_COMPRADOR', 0.38 + 0.25 * st + 0.18 * coverage WHERE c.c < o AND delta > 0
    UNION ALL SELECT 'ESFORCO_AGRESSOR_SEM_RESULTADO', 0.48 + least(0.22, effort * 0.10) + 0.15 * coverage WHERE effort IS NOT NULL
    UNION ALL SELECT 'PERDA_EFICIENCIA_FLUXO', 0.58 + least(0.20, (1 - greatest(0.0, fall)) * 0.20) WHERE fall IS NOT NULL
    UNION ALL SELECT 'REJEICAO_MAXIMA', 0.58 + least(0.18, (h - greatest(o, c.c)) / greatest(sp, 1) * 0.20) + 0.10 WHERE (h - greatest(o, c.c)) / greatest(sp, 1) >= 0.25 AND nh
    UNION ALL SELECT 'REJEICAO_MINIMA', 0.58 + least(0.18, (least(o, c.c) - l) / greatest(sp, 1) * 0.20) + 0.10 WHERE (least(o, c.c) - l) / greatest(sp, 1) >= 0.25 AND nl
    UNION ALL SELECT 'DISPUTA_EQUILIBRADA', 0.60 + 0.15 * coverage WHERE directed > 0 AND st < 0.15 AND zone = 'MEIO'
    UNION ALL SELECT 'MUDANCA_CONTROLE_INTRABAR', 0.66 WHERE np >= 3 AND w0 <> w1 AND w0 IN ('COMPRA', 'VENDA') AND w1 IN ('COMPRA', 'VENDA')
  ) x
)"""

BASE = f"""
t AS (
  SELECT 'SYM' || (user_id % 2) AS symbol, epoch_us(ts) AS us, CAST(ts AS DATE) AS session_date,
         CAST(round(value * 100) AS BIGINT) AS p, CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 + 1 AS q, event_id AS seq,
         CASE WHEN event_type IN ('purchase', 'click') THEN 'BUY' WHEN event_type IN ('view', 'error') THEN 'SELL' ELSE 'NONE' END AS side,
         event_type = 'signup' AND event_id % 2 = 0 AS rlp,
         CASE WHEN event_id % 11 = 0 THEN '' ELSE 'B' || (user_id % 7) END AS buyer,
         CASE WHEN event_id % 11 = 0 THEN '' ELSE 'S' || (user_id % 5) END AS seller,
         epoch_us(ts) // 1000000 // {N} * {N} AS start
  FROM events
),
b AS (
  SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY {ID}) AS n,
         p - lag(p) OVER w AS d, (us - lag(us) OVER w) / 1000.0 AS gap,
         max(p) OVER (PARTITION BY {ID}) AS hi, min(p) OVER (PARTITION BY {ID}) AS lo
  FROM t WINDOW w AS (PARTITION BY {ID} ORDER BY us, seq)
),
c AS (
  SELECT symbol, start, arg_min(p, idx) AS o, max(p) AS h, min(p) AS l, arg_max(p, idx) AS c, CAST(sum(q) AS BIGINT) AS v, count(*) AS k,
         min(us) AS us0, max(us) AS us1
  FROM b GROUP BY {ID}
),
refs AS (
  SELECT symbol, start + CASE WHEN start // {N} % 13 = 0 THEN 86400000 ELSE 0 END AS start, o, h + CASE WHEN start // {N} % 11 = 0 THEN 1 ELSE 0 END AS h,
         l, c, v + CASE WHEN start // {N} % 7 = 0 THEN 1 ELSE 0 END AS v
  FROM c
),
signs AS (
  SELECT *, lag(sign(d)) OVER (PARTITION BY {ID} ORDER BY idx) AS before FROM b WHERE d <> 0
),
rev AS (SELECT symbol, start, count(*) FILTER (WHERE sign(d) <> before) AS reversals, count(*) AS changes FROM signs GROUP BY {ID}),
runs AS (
  SELECT symbol, start, count(*) FILTER (WHERE p = hi) AS high_visits, count(*) FILTER (WHERE p = lo) AS low_visits, count(*) AS runs, count(DISTINCT p) AS prices
  FROM b WHERE idx = 0 OR d <> 0 GROUP BY {ID}
),
poc AS (SELECT symbol, start, arg_max(p, (lq, -p)) AS poc FROM (SELECT symbol, start, p, sum(q) AS lq FROM b GROUP BY ALL) GROUP BY {ID}),
swing AS (
  SELECT symbol, start, max(rh - p) AS dd, max(p - rl) AS du FROM (
    SELECT symbol, start, p, max(p) OVER w AS rh, min(p) OVER w AS rl FROM b WINDOW w AS (PARTITION BY {ID} ORDER BY idx ROWS UNBOUNDED PRECEDING)) GROUP BY {ID}
),
dna0 AS (
  SELECT b.symbol, b.start, any_value(hi) AS hi, any_value(lo) AS lo, arg_min(p, idx) AS o, arg_max(p, idx) AS c, count(*) AS k, CAST(sum(q) AS BIGINT) AS v,
         CAST(coalesce(sum(abs(d)), 0) AS BIGINT) AS path, count(*) FILTER (WHERE d = 0) AS still, min(us) AS us0,
         min(idx) FILTER (WHERE p = hi) AS hi_i, min(idx) FILTER (WHERE p = lo) AS lo_i, min(us) FILTER (WHERE p = hi) AS hi_us, min(us) FILTER (WHERE p = lo) AS lo_us,
         CAST(sum(p * q) AS BIGINT) AS pq, max(q) AS max_q,
         CAST(coalesce(sum(q) FILTER (WHERE side = 'BUY'), 0) AS BIGINT) AS buy, CAST(coalesce(sum(q) FILTER (WHERE side = 'SELL'), 0) AS BIGINT) AS sell,
         coalesce(sum(q) FILTER (WHERE hi > lo AND p <= lo + (hi - lo) / 3.0), 0) AS low_q,
         coalesce(sum(q) FILTER (WHERE hi > lo AND p > lo + (hi - lo) / 3.0 AND p >= hi - (hi - lo) / 3.0), 0) AS high_q,
         CASE WHEN count(*) > 1 THEN (max(us) - min(us)) / 1000.0 / (count(*) - 1) ELSE 0 END AS g_avg, coalesce(quantile_cont(gap, 0.5), 0) AS g_med, coalesce(quantile_cont(gap, 0.95), 0) AS g_95, coalesce(max(gap), 0) AS g_max
  FROM b GROUP BY b.symbol, b.start
),
dna AS (
  SELECT symbol, start, hi - lo AS range_ticks, path AS path_distance_ticks, c - o AS net_displacement_ticks,
         CASE WHEN path > 0 THEN abs(c - o) / path ELSE 0 END AS directional_efficiency, CASE WHEN path > 0 THEN (hi - lo) / path ELSE 0 END AS range_efficiency,
         CASE WHEN hi > lo THEN (c - o) / (hi - lo) ELSE 0 END AS body_to_range, CASE WHEN hi > lo THEN (c - lo) / (hi - lo) ELSE 0.5 END AS close_location,
         coalesce(reversals, 0) AS reversals, coalesce(reversals / greatest(changes - 1, 1), 0) AS reversal_rate, coalesce(changes, 0) AS price_change_events,
         still AS unchanged_transitions, prices AS unique_prices,
         CASE WHEN hi = lo THEN 'FLAT' WHEN hi_i < lo_i THEN 'HIGH_FIRST' ELSE 'LOW_FIRST' END AS high_first,
         (hi_us - us0) / 1000.0 AS time_to_high_ms, (lo_us - us0) / 1000.0 AS time_to_low_ms, high_visits, low_visits,
         runs - prices AS total_revisits, (runs - prices) / k AS revisit_rate, poc AS most_traded_price_ticks, pq / v AS vwap_ticks, v / k AS mean_trade_size, max_q AS max_trade_size,
         buy AS buy_aggression_qty, sell AS sell_aggression_qty, v - buy - sell AS unknown_aggression_qty, (buy + sell) / v AS aggressor_coverage,
         CASE WHEN buy + sell > 0 THEN (buy - sell) / (buy + sell) END AS aggression_imbalance,
         high_q / v AS upper_third_volume_share, (v - high_q - low_q) / v AS middle_third_volume_share, low_q / v AS lower_third_volume_share,
         hi - o AS up_excursion_ticks, o - lo AS down_excursion_ticks, dd AS max_drawdown_ticks, du AS max_drawup_ticks,
         g_avg AS avg_intertrade_ms, g_med AS median_intertrade_ms, g_95 AS p95_intertrade_ms, g_max AS max_intertrade_ms, k / {N}.0 AS trades_per_second, k AS trades, v AS volume
  FROM dna0 LEFT JOIN rev USING (symbol, start) JOIN runs USING (symbol, start) JOIN poc USING (symbol, start) JOIN swing USING (symbol, start)
),
lv0 AS (
  SELECT symbol, start, p, CAST(sum(q) AS BIGINT) AS volume, count(*) AS trades, CAST(coalesce(sum(q) FILTER (WHERE side = 'BUY'), 0) AS BIGINT) AS buy,
         CAST(coalesce(sum(q) FILTER (WHERE side = 'SELL'), 0) AS BIGINT) AS sell, CAST(coalesce(sum(q) FILTER (WHERE rlp), 0) AS BIGINT) AS rlp,
         CAST(coalesce(sum(q) FILTER (WHERE side = 'NONE' AND NOT rlp), 0) AS BIGINT) AS unknown, count(*) FILTER (WHERE idx = 0 OR d <> 0) AS visits,
         max(idx) AS last_i, max(n) AS n
  FROM b GROUP BY ALL
),
lv1 AS (
  SELECT x.*, buy + sell AS directed, buy - sell AS delta, CASE WHEN buy + sell > 0 THEN abs(buy - sell) / (buy + sell) END AS dominance,
         (SELECT max(y.p) FROM b y WHERE y.symbol = x.symbol AND y.start = x.start AND y.idx > x.last_i) AS amax,
         (SELECT min(y.p) FROM b y WHERE y.symbol = x.symbol AND y.start = x.start AND y.idx > x.last_i) AS amin
  FROM lv0 x
),
pos AS (SELECT symbol, start, median(directed) AS med, count(*) AS levels, sum(directed) AS known FROM lv1 WHERE directed > 0 GROUP BY {ID}),
rk AS (SELECT symbol, start, p, cume_dist() OVER (PARTITION BY {ID} ORDER BY directed) AS r FROM lv1 WHERE directed > 0),
lv2 AS (
  SELECT lv1.*, coalesce(r, 0) AS percentile, CASE WHEN directed > 0 THEN directed / med ELSE 0 END AS vs_median, levels,
         CASE WHEN directed > 0 THEN directed / known ELSE 0 END AS share,
         CASE WHEN directed = 0 THEN 'SEM_DIRECAO' WHEN dominance < 0.15 THEN 'EQUILIBRADA' WHEN delta > 0 THEN 'COMPRA' ELSE 'VENDA' END AS direction
  FROM lv1 LEFT JOIN pos USING (symbol, start) LEFT JOIN rk USING (symbol, start, p)
),
lv3 AS (
  SELECT *, CASE WHEN directed = 0 THEN 'SEM_AGRESSAO_DIRECIONADA'
              WHEN levels < 4 THEN CASE WHEN vs_median >= 2.5 THEN 'EXTREMA' WHEN vs_median >= 1.5 THEN 'ALTA' WHEN vs_median >= 0.75 THEN 'MODERADA' ELSE 'BAIXA' END
              WHEN percentile >= 0.9 THEN 'EXTREMA' WHEN percentile >= 0.7 THEN 'ALTA' WHEN percentile >= 0.4 THEN 'MODERADA' ELSE 'BAIXA' END AS intensity,
         CASE direction WHEN 'COMPRA' THEN greatest(0, coalesce(amax - p, 0)) WHEN 'VENDA' THEN greatest(0, coalesce(p - amin, 0)) ELSE 0 END AS favorable_ticks,
         CASE direction WHEN 'COMPRA' THEN greatest(0, coalesce(p - amin, 0)) WHEN 'VENDA' THEN greatest(0, coalesce(amax - p, 0)) ELSE 0 END AS adverse_ticks,
         n - 1 - last_i AS future
  FROM lv2
),
lv AS (
  SELECT *, CASE WHEN direction NOT IN ('COMPRA', 'VENDA') THEN 'DISPUTA_OU_INDEFINIDA' WHEN future = 0 THEN 'SEM_JANELA_POS_AGRESSAO'
              WHEN intensity NOT IN ('ALTA', 'EXTREMA') OR dominance < 0.5 THEN 'PRESSAO_SEM_CONFIRMACAO'
              WHEN favorable_ticks >= 2 AND favorable_ticks > adverse_ticks THEN 'IMPULSO_COMPATIVEL'
              WHEN favorable_ticks <= 1 AND visits >= 2 THEN 'POSSIVEL_ABSORCAO' ELSE 'PRESSAO_SEM_CONFIRMACAO' END AS response
  FROM lv3
),
f0 AS (
  SELECT symbol, start, CAST(sum(q) AS BIGINT) AS volume, count(*) AS trades, CAST(coalesce(sum(q) FILTER (WHERE side = 'BUY'), 0) AS BIGINT) AS buy,
         CAST(coalesce(sum(q) FILTER (WHERE side = 'SELL'), 0) AS BIGINT) AS sell, CAST(coalesce(sum(q) FILTER (WHERE rlp), 0) AS BIGINT) AS rlp,
         CAST(coalesce(sum(q) FILTER (WHERE side = 'NONE' AND NOT rlp), 0) AS BIGINT) AS unknown,
         count(*) FILTER (WHERE side = 'BUY') AS buy_trades, count(*) FILTER (WHERE side = 'SELL') AS sell_trades, count(*) FILTER (WHERE rlp) AS rlp_trades,
         coalesce(sum(q) FILTER (WHERE side = 'BUY' AND buyer <> '' OR side = 'SELL' AND seller <> ''), 0) AS identified,
         arg_max(p, idx) - arg_min(p, idx) AS price_change, count(DISTINCT p) AS levels
  FROM b GROUP BY {ID}
),
f1 AS (
  SELECT *, buy + sell AS directed, buy - sell AS delta, (buy + sell) / volume AS coverage, CASE WHEN buy + sell > 0 THEN abs(buy - sell) / (buy + sell) END AS dominance,
         CASE WHEN buy + sell > 0 THEN identified / (buy + sell) ELSE 0 END AS identity_coverage,
         CASE WHEN price_change > 0 THEN 'ALTA' WHEN price_change < 0 THEN 'BAIXA' ELSE 'NEUTRO' END AS price_direction
  FROM f0
),
f2 AS (
  SELECT *, CASE WHEN directed = 0 THEN 'SEM_DIRECAO' WHEN dominance < 0.15 THEN 'EQUILIBRADA' WHEN delta > 0 THEN 'COMPRA' ELSE 'VENDA' END AS direction FROM f1
),
f3 AS (
  SELECT *, CASE WHEN directed = 0 THEN 'DADOS_INSUFICIENTES' WHEN price_change = 0 THEN 'PRECO_NEUTRO' WHEN direction = 'EQUILIBRADA' THEN 'FLUXO_EQUILIBRADO'
              WHEN (price_change > 0) = (direction = 'COMPRA') THEN 'ALINHADO' ELSE 'DIVERGENTE' END AS relation,
         CASE WHEN directed = 0 THEN 'SEM_DADOS' WHEN dominance < 0.15 THEN 'EQUILIBRADO' WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS eside,
         CASE WHEN directed = 0 THEN 'DADOS_INSUFICIENTES' WHEN direction = 'EQUILIBRADA' THEN 'FLUXO_EQUILIBRADO' WHEN price_change = 0 THEN 'PRECO_NEUTRO'
              WHEN (price_change > 0) = (direction = 'COMPRA') THEN 'ALINHADO' ELSE 'DIVERGENTE' END AS erelation
  FROM f2
),
f AS (
  SELECT *, CASE WHEN relation <> 'DIVERGENTE' THEN 'NORMAL' WHEN coverage >= 0.7 AND dominance >= 0.2 THEN 'ALTA' WHEN coverage >= 0.5 THEN 'MODERADA' ELSE 'BAIXA' END AS priority FROM f3
),
ph0 AS (
  SELECT symbol, start, CASE WHEN idx < n // 3 THEN 0 WHEN idx < 2 * n // 3 THEN 1 ELSE 2 END AS phase_no, count(*) AS trades, CAST(sum(q) AS BIGINT) AS volume,
         CAST(coalesce(sum(q) FILTER (WHERE side = 'BUY'), 0) AS BIGINT) AS buy, CAST(coalesce(sum(q) FILTER (WHERE side = 'SELL'), 0) AS BIGINT) AS sell,
         arg_max(p, idx) - arg_min(p, idx) AS price_change, greatest(1.0, (max(us) - min(us)) / 1e6) AS seconds
  FROM b GROUP BY ALL
),
ph1 AS (
  SELECT *, ['INICIO', 'MEIO', 'FINAL'][phase_no + 1] AS phase, buy + sell AS directed, buy - sell AS delta, CASE WHEN buy + sell > 0 THEN abs(buy - sell) / (buy + sell) END AS dominance,
         CASE WHEN buy > 0 THEN price_change * 1000.0 / buy END AS buy_response, CASE WHEN sell > 0 THEN price_change * -1000.0 / sell END AS sell_response,
         (buy + sell) / seconds AS contracts_per_second
  FROM ph0
),
ph2 AS (SELECT *, CASE WHEN directed = 0 THEN 'SEM_DADOS' WHEN dominance < 0.15 THEN 'EQUILIBRADO' WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS flow_direction FROM ph1),
ph3 AS (SELECT *, CASE flow_direction WHEN 'BUY' THEN buy_response WHEN 'SELL' THEN sell_response END AS response FROM ph2),
ph4 AS (
  SELECT *, directed / median(directed) FILTER (WHERE directed > 0) OVER (PARTITION BY {ID}) AS effort_vs_median, median(response) FILTER (WHERE response > 0) OVER (PARTITION BY {ID}) AS usual FROM ph3
),
ph AS (
  SELECT *, CASE WHEN directed = 0 THEN 'SEM_DADOS' WHEN flow_direction = 'EQUILIBRADO' THEN 'FLUXO_EQUILIBRADO' WHEN response < 0 THEN 'RESPOSTA_OPOSTA' WHEN response = 0 THEN 'SEM_RESPOSTA'
              WHEN response / usual >= 1.5 THEN 'ALTA' WHEN response / usual >= 0.5 THEN 'MODERADA' ELSE 'BAIXA' END AS label FROM ph4
),
eff AS (SELECT * FROM ph WHERE effort_vs_median >= 1 AND label IN ('BAIXA', 'SEM_RESPOSTA', 'RESPOSTA_OPOSTA')),
sides AS (
  SELECT symbol, start, phase_no, phase, 'BUY' AS side, buy AS vol, buy_response AS resp FROM ph WHERE buy > 0
  UNION ALL SELECT symbol, start, phase_no, phase, 'SELL', sell, sell_response FROM ph WHERE sell > 0
),
dec0 AS (
  SELECT symbol, start, side, count(*) AS m, arg_min(phase, phase_no) AS from_phase, arg_max(phase, phase_no) AS to_phase, arg_min(resp, phase_no) AS r0, arg_max(resp, phase_no) AS r1,
         arg_min(vol, phase_no) AS v0, arg_max(vol, phase_no) AS v1 FROM sides GROUP BY ALL
),
dec AS (SELECT *, r1 / r0 AS efficiency_ratio FROM dec0 WHERE m >= 2 AND r0 > 0 AND v1 >= greatest(1, floor(v0 * 0.5)) AND r1 / r0 <= 0.4),
par AS (
  SELECT symbol, start, CASE WHEN price_change < 0 AND buy > sell THEN 'BAIXA_COM_COMPRA_AGRESSORA_DOMINANTE' WHEN price_change > 0 AND sell > buy THEN 'ALTA_COM_VENDA_AGRESSORA_DOMINANTE'
         ELSE 'DIVERGENCIA_PRECO_FLUXO' END AS code, least(1.0, 0.45 + 0.30 * coalesce(dominance, 0) + 0.25 * coverage) AS score
  FROM f WHERE coverage >= 0.3 AND erelation = 'DIVERGENTE'
  UNION ALL SELECT symbol, start, 'AGRESSAO_FORTE_SEM_DESLOCAMENTO', least(1.0, 0.35 + least(max(effort_vs_median), 2.0) * 0.20 + 0.25 * any_value(coverage))
  FROM eff JOIN (SELECT symbol, start, coverage FROM f WHERE coverage >= 0.3) USING (symbol, start) GROUP BY symbol, start
  UNION ALL SELECT symbol, start, 'PERDA_EFICIENCIA_' || side, least(1.0, 0.55 + (1 - greatest(0.0, CASE WHEN efficiency_ratio = 0 THEN 1.0 ELSE efficiency_ratio END)) * 0.35)
  FROM dec JOIN (SELECT symbol, start FROM f WHERE coverage >= 0.3) USING (symbol, start)
  UNION ALL SELECT symbol, start, 'AGRESSAO_ACELERA_E_EFICIENCIA_CAI', least(1.0, 0.62 + least(s1 / greatest(s0, 1e-9) - 1, 1.0) * 0.20)
  FROM (SELECT symbol, start, contracts_per_second AS s1, response AS r1, lag(contracts_per_second) OVER w AS s0, lag(response) OVER w AS r0 FROM ph WINDOW w AS (PARTITION BY {ID} ORDER BY phase_no))
  JOIN (SELECT symbol, start FROM f WHERE coverage >= 0.3) USING (symbol, start) WHERE s1 > s0 * 1.15 AND r1 < r0 * 0.6
),
ql0 AS (
  SELECT symbol, session_date, us, us - lag(us) OVER (PARTITION BY symbol, session_date ORDER BY us, seq) AS g, lag(us) OVER (PARTITION BY symbol, session_date ORDER BY us, seq) AS from_us FROM t
),
ql1 AS (SELECT symbol, session_date, coalesce(quantile_cont(g / 1e6, 0.95), 0) AS p95 FROM ql0 GROUP BY ALL),
ql2 AS (SELECT *, greatest(60.0, least(300.0, greatest(1.0, p95) * 20)) AS thr, epoch_us(CAST(session_date AS TIMESTAMP)) AS d0 FROM ql1),
ql3 AS (
  SELECT symbol, session_date, any_value(p95) AS p95, any_value(thr) AS thr, any_value(d0) AS d0, min(us) AS us0, max(us) AS us1, count(*) AS trades, count(*) FILTER (WHERE g / 1e6 > thr) AS gap_count,
         coalesce(max(g / 1e6), 0) AS max_gap, coalesce(sum(g / 1e6 - thr) FILTER (WHERE g / 1e6 > thr), 0) AS excess, count(DISTINCT (us - d0) // 60000000) AS minutes
  FROM ql0 JOIN ql2 USING (symbol, session_date) GROUP BY ALL
),
ql4 AS (
  SELECT *, least(1.0, greatest(0.0, (us1 - us0) / 1e6) / 86400) AS cov, (us0 - d0) / 1e6 AS delay, (d0 + 86400000000 - us1) / 1e6 AS early, minutes / 1440 AS act FROM ql3
),
ql5 AS (
  SELECT *, round(greatest(0.0, least(100.0, 100 * (0.35 * cov + 0.18 * CASE WHEN delay <= 120 THEN 1 ELSE greatest(0.0, 1 - (delay - 120) / 780) END
         + 0.18 * CASE WHEN early <= 120 THEN 1 ELSE greatest(0.0, 1 - (early - 120) / 780) END + 0.19 * act + 0.10 * greatest(0.0, 1 - excess / (86400 * 0.08))))), 1) AS score FROM ql4
),
ql AS (
  SELECT *, CASE WHEN delay > 300 AND early > 300 THEN 'PARTIAL_BOTH' WHEN delay > 300 THEN 'PARTIAL_START' WHEN early > 300 THEN 'PARTIAL_END' WHEN max_gap > 300 OR act < 0.9 THEN 'GAPPED'
         WHEN cov >= 0.985 AND act >= 0.97 AND score >= 94 THEN 'COMPLETE' WHEN cov >= 0.965 AND act >= 0.94 AND score >= 88 THEN 'LIKELY_COMPLETE' ELSE 'REVIEW' END AS status FROM ql5
),
s AS (
  SELECT *, {DAY} AS session_date, h - l AS span, lag(c) OVER w AS pc, first_value(o) OVER w AS so FROM c WINDOW w AS (PARTITION BY symbol, start // 86400 ORDER BY start)
),
sp AS (SELECT *, abs(c - coalesce(pc, o)) AS step, row_number() OVER (PARTITION BY symbol, session_date ORDER BY start) AS i FROM s),
fr AS (
  SELECT x.symbol, x.start, k.name, arg_max(y.c, y.start) - arg_min(y.o, y.start) AS net, max(y.h) - min(y.l) AS span,
         sum(CASE WHEN y.i = greatest(1, x.i - k.back) THEN abs(y.c - y.o) ELSE abs(y.c - y.pc) END) AS path
  FROM sp x CROSS JOIN (VALUES ('short', 4), ('medium', 14), ('to_date', 1000000)) k(name, back)
  JOIN sp y ON y.symbol = x.symbol AND y.session_date = x.session_date AND y.i BETWEEN x.i - k.back AND x.i GROUP BY ALL
),
se AS (SELECT symbol, session_date, arg_max(c, start) - arg_min(o, start) AS net, max(h) - min(l) AS span, sum(step) AS path, median(h - l) FILTER (WHERE h > l) AS med, arg_min(o, start) AS o, arg_max(c, start) AS c FROM sp GROUP BY ALL),
reg AS (
  SELECT symbol, start, NULL AS session_date, name, net, span, path FROM fr UNION ALL SELECT symbol, NULL, session_date, 'session', net, span, path FROM se
),
rg AS (
  SELECT *, CASE WHEN path > 0 THEN abs(net) / path ELSE 0 END AS eff, CASE WHEN span > 0 THEN abs(net) / span ELSE 0 END AS ntr FROM reg
),
rgl AS (
  SELECT *, CASE WHEN span = 0 THEN 'RANGE' WHEN ntr >= 0.55 AND eff >= 0.25 THEN CASE WHEN net > 0 THEN 'TREND_UP' ELSE 'TREND_DOWN' END WHEN ntr <= 0.28 OR eff <= 0.12 THEN 'RANGE' ELSE 'MIXED' END AS regime FROM rg
),
og0 AS (SELECT symbol, session_date, o - lag(c) OVER w AS gap, lag(span) OVER w AS before FROM se WINDOW w AS (PARTITION BY symbol ORDER BY session_date)),
og AS (
  SELECT symbol, session_date, gap, r, CASE WHEN gap IS NULL OR r IS NULL THEN 'NO_PREVIOUS_SESSION' WHEN abs(r) < 0.1 OR gap = 0 THEN 'NONE'
         ELSE CASE WHEN abs(r) < 0.25 THEN 'SMALL' WHEN abs(r) < 0.5 THEN 'MEDIUM' ELSE 'LARGE' END || CASE WHEN gap > 0 THEN '_UP' ELSE '_DOWN' END END AS bucket
  FROM (SELECT *, CASE WHEN before <> 0 THEN gap / before WHEN gap = 0 THEN 0 END AS r FROM og0)
),
ri AS (
  SELECT sp.symbol, sp.start, sp.session_date, sp.o, sp.h, sp.l, sp.c, CASE WHEN sp.span = 0 OR sp.c = sp.o THEN 'DOJI' WHEN sp.c > sp.o THEN 'BULLISH' ELSE 'BEARISH' END AS direction,
         CASE WHEN sp.span > 0 THEN abs(sp.c - sp.o) / sp.span ELSE 0 END AS body_share, CASE WHEN sp.span > 0 THEN (sp.h - greatest(sp.o, sp.c)) / sp.span ELSE 0 END AS upper_wick_share,
         CASE WHEN sp.span > 0 THEN (least(sp.o, sp.c) - sp.l) / sp.span ELSE 0 END AS lower_wick_share, coalesce(sp.span / med, CASE WHEN sp.span = 0 THEN 1.0 ELSE 99.0 END) AS volatility_ratio,
         z.regime AS session_regime, z.eff AS session_eff, z.ntr AS session_ntr, a.regime AS regime_short, m.regime AS regime_medium, d.regime AS regime_to_date, og.gap, og.r, og.bucket
  FROM sp JOIN se USING (symbol, session_date) JOIN og USING (symbol, session_date) JOIN rgl z ON z.name = 'session' AND z.symbol = sp.symbol AND z.session_date = sp.session_date
  JOIN rgl a ON a.name = 'short' AND a.symbol = sp.symbol AND a.start = sp.start JOIN rgl m ON m.name = 'medium' AND m.symbol = sp.symbol AND m.start = sp.start
  JOIN rgl d ON d.name = 'to_date' AND d.symbol = sp.symbol AND d.start = sp.start
),
rx AS (
  SELECT ri.*, CASE WHEN volatility_ratio < 0.65 THEN 'LOW' WHEN volatility_ratio < 1.35 THEN 'NORMAL' WHEN volatility_ratio < 2.25 THEN 'HIGH' ELSE 'EXTREME' END AS volatility_bucket,
         dna.* EXCLUDE (symbol, start) FROM ri JOIN dna USING (symbol, start)
),
fam AS (
  SELECT symbol, start, CASE WHEN rng = 0 THEN 'FLAT' WHEN lo < o AND lf AND c > o AND (c - lo) / rng >= 0.65 THEN 'SWEEP_LOW_REVERSAL' WHEN hi > o AND hf AND c < o AND (hi - c) / rng >= 0.65 THEN 'SWEEP_HIGH_REVERSAL'
         WHEN c > o AND de >= 0.55 AND c >= hi - 0.15 * rng THEN 'DIRECT_IMPULSE_UP' WHEN c < o AND de >= 0.55 AND c <= lo + 0.15 * rng THEN 'DIRECT_IMPULSE_DOWN'
         WHEN half_lo <= lo + 0.15 * rng AND c >= o AND lf THEN 'V_SHAPED' WHEN half_hi >= hi - 0.15 * rng AND c <= o AND hf THEN 'INVERTED_V' WHEN hi > o AND lo < o AND rr >= 0.25 THEN 'DOUBLE_EXCURSION'
         WHEN c > o AND o > lo THEN 'PULLBACK_CONTINUATION_UP' WHEN c < o AND hi > o THEN 'PULLBACK_CONTINUATION_DOWN' WHEN rr >= 0.2 OR de <= 0.25 THEN 'OSCILLATING_RANGE' ELSE 'UNCLASSIFIED' END AS family, rng, o, c, hi, lo, de, rr
  FROM (SELECT symbol, start, hi - lo AS rng, x.o, x.c, x.hi, x.lo, half_lo, half_hi, directional_efficiency AS de, reversal_rate AS rr, high_first = 'HIGH_FIRST' AS hf, high_first = 'LOW_FIRST' AS lf
        FROM (SELECT symbol, start, arg_min(p, idx) AS o, arg_max(p, idx) AS c, any_value(hi) AS hi, any_value(lo) AS lo, min(p) FILTER (WHERE idx <= n // 2) AS half_lo, max(p) FILTER (WHERE idx <= n // 2) AS half_hi FROM b GROUP BY {ID}) x
        JOIN dna USING (symbol, start))
),
famx AS (
  SELECT *, CASE family WHEN 'FLAT' THEN 1.0 WHEN 'SWEEP_LOW_REVERSAL' THEN least(1.0, 0.55 + 0.35 * (c - lo) / rng) WHEN 'SWEEP_HIGH_REVERSAL' THEN least(1.0, 0.55 + 0.35 * (hi - c) / rng)
         WHEN 'DIRECT_IMPULSE_UP' THEN least(1.0, 0.55 + 0.45 * de) WHEN 'DIRECT_IMPULSE_DOWN' THEN least(1.0, 0.55 + 0.45 * de) WHEN 'V_SHAPED' THEN 0.65 WHEN 'INVERTED_V' THEN 0.65
         WHEN 'DOUBLE_EXCURSION' THEN least(1.0, 0.55 + rr / 2) WHEN 'PULLBACK_CONTINUATION_UP' THEN 0.58 WHEN 'PULLBACK_CONTINUATION_DOWN' THEN 0.58 WHEN 'OSCILLATING_RANGE' THEN least(1.0, 0.55 + (1 - de) * 0.3) ELSE 0.35 END AS confidence,
         {DAY} AS session_date FROM fam
),
nx AS (
  SELECT *, CASE WHEN lead(start) OVER w = start + {N} THEN lead(family) OVER w END AS f1, CASE WHEN lead(start) OVER w = start + {N} AND lead(start, 2) OVER w = start + 2 * {N} THEN lead(family, 2) OVER w END AS f2
  FROM famx WINDOW w AS (PARTITION BY symbol, session_date ORDER BY start)
),
{HYPOTHESES},
el AS (
  SELECT c.*, {DAY.replace('start', 'c.start')} AS session_date FROM c JOIN refs ON refs.symbol = c.symbol AND refs.start = c.start AND refs.o = c.o AND refs.h = c.h AND refs.l = c.l AND refs.c = c.c AND refs.v = c.v
),
ah AS (
  SELECT x.symbol, x.start, k.h AS horizon, arg_max(y.c, y.start) - x.c AS delta, greatest(0, max(y.h) - x.c) AS up, greatest(0, x.c - min(y.l)) AS down
  FROM el x CROSS JOIN (VALUES (1), (3), (5)) k(h) JOIN el y ON y.symbol = x.symbol AND y.session_date = x.session_date AND y.start > x.start AND y.start <= x.start + k.h * {N}
  GROUP BY x.symbol, x.start, x.c, k.h HAVING count(*) = k.h
),
bl AS (SELECT symbol, horizon, count(*) AS eligible, count(*) FILTER (WHERE delta > 0) AS up, count(*) FILTER (WHERE delta < 0) AS down FROM ah GROUP BY ALL)
"""


def sql(body: str, *more: str) -> str:
    recursive = "RECURSIVE " if any("_s AS (" in x for x in more) else ""
    return f"WITH {recursive}{', '.join([BASE.strip(), *more])}\n{body}"


def waves(name: str, interval: int, rules) -> list[str]:
    """The wave detector by recursion over each candle's trades: ``{name}_b`` (trades), ``{name}_s`` (a state for each trade, with the wave
    that it ends), ``{name}`` (ended and open waves)."""
    w = f"(PARTITION BY symbol, start ORDER BY idx ROWS BETWEEN {rules.window - 1} PRECEDING AND CURRENT ROW)"
    return [
        f"""{name}_b AS MATERIALIZED (
  SELECT symbol, start, idx, p, q, side AS trade_side, buyer, seller, CAST(buy AS BIGINT) AS buy, CAST(sell AS BIGINT) AS sell, CASE WHEN buy + sell > 0 THEN (buy - sell) / (buy + sell) ELSE 0.0 END AS dom, (buy + sell) / total AS cov
  FROM (SELECT *, coalesce(sum(q) FILTER (WHERE side = 'BUY') OVER w, 0) AS buy, coalesce(sum(q) FILTER (WHERE side = 'SELL') OVER w, 0) AS sell, sum(q) OVER w AS total
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol, start ORDER BY us, seq) - 1 AS idx FROM (SELECT * REPLACE (us // 1000000 // {interval} * {interval} AS start) FROM t)) WINDOW w AS {w})
)""",
        f"""{name}_s AS (
  SELECT symbol, start, CAST(-1 AS BIGINT) AS idx, CAST(NULL AS VARCHAR) AS side, CAST(NULL AS VARCHAR) AS ending, CAST(NULL AS VARCHAR) AS leaning, CAST(0 AS BIGINT) AS first_i, CAST(0 AS BIGINT) AS run,
         CAST(0 AS BIGINT) AS s0, CAST(0 AS BIGINT) AS pk_i, CAST(0 AS BIGINT) AS pk_q, CAST(0 AS DOUBLE) AS pk_d, CAST(0 AS BIGINT) AS wave,
         CAST(NULL AS VARCHAR) AS e_side, CAST(NULL AS BIGINT) AS e_s0, CAST(NULL AS BIGINT) AS e_pk_i, CAST(NULL AS BIGINT) AS e_pk_q, CAST(NULL AS DOUBLE) AS e_pk_d, CAST(NULL AS VARCHAR) AS e_type,
         CAST(NULL AS BIGINT) AS e_qty, CAST(NULL AS BIGINT) AS e_oth, CAST(NULL AS DOUBLE) AS e_cov, CAST(NULL AS DOUBLE) AS e_dom, CAST(NULL AS DOUBLE) AS e_decay
  FROM (SELECT DISTINCT symbol, start FROM {name}_b)
  UNION ALL
  SELECT symbol, start, idx, CASE WHEN ends THEN NULL WHEN begins THEN lside ELSE side END, CASE WHEN ends OR begins OR early THEN CASE WHEN early THEN ending END WHEN side IS NULL THEN ending ELSE kind END,
         CASE WHEN early THEN leaning WHEN ends OR begins THEN NULL WHEN side IS NULL THEN lside ELSE leaning END, CASE WHEN early OR side IS NOT NULL THEN first_i ELSE nfirst END,
         CASE WHEN early THEN run WHEN ends OR begins THEN 0 ELSE nrun END, CASE WHEN begins THEN nfirst ELSE s0 END, CASE WHEN begins THEN idx ELSE npk_i END, CASE WHEN begins THEN lqty ELSE npk_q END, CASE WHEN begins THEN abs(dom) ELSE npk_d END,
         wave + CASE WHEN ends THEN 1 ELSE 0 END, CASE WHEN ends THEN side END, CASE WHEN ends THEN s0 END, CASE WHEN ends THEN npk_i END, CASE WHEN ends THEN npk_q END, CASE WHEN ends THEN npk_d END, CASE WHEN ends THEN kind END,
         CASE WHEN ends THEN qty END, CASE WHEN ends THEN oth END, CASE WHEN ends THEN cov END, CASE WHEN ends THEN dom END, CASE WHEN ends THEN 1.0 - least(qty / greatest(npk_q, 1), 1.0) END
  FROM (SELECT *, NOT early AND side IS NULL AND lside IS NOT NULL AND nrun >= {rules.confirm_start} AS begins, NOT early AND side IS NOT NULL AND kind IS NOT NULL AND nrun >= {rules.confirm_end} AS ends
    FROM (SELECT *, CASE WHEN side IS NULL THEN CASE WHEN lside IS NULL THEN 0 WHEN lside = leaning THEN run + 1 ELSE 1 END WHEN kind IS NULL THEN 0 WHEN kind = ending THEN run + 1 ELSE 1 END AS nrun,
                 CASE WHEN lside IS NULL OR lside IS DISTINCT FROM leaning THEN idx ELSE first_i END AS nfirst
      FROM (SELECT *, CASE WHEN side IS NOT NULL AND NOT early THEN CASE WHEN cov >= {rules.coverage} AND -same >= {rules.takeover} THEN 'TROCA_CONTROLE' WHEN same <= {rules.release} THEN CASE WHEN qty / greatest(npk_q, 1) <= {rules.decay} THEN 'EXAUSTAO' ELSE 'NEUTRALIZACAO' END END END AS kind
        FROM (SELECT *, CASE WHEN side IS NOT NULL AND NOT early AND qty > pk_q THEN idx ELSE pk_i END AS npk_i, CASE WHEN side IS NOT NULL AND NOT early THEN greatest(pk_q, qty) ELSE pk_q END AS npk_q, CASE WHEN side IS NOT NULL AND NOT early THEN greatest(pk_d, same) ELSE pk_d END AS npk_d
          FROM (SELECT s.symbol, s.start, n.idx, s.side, s.ending, s.leaning, s.first_i, s.run, s.s0, s.pk_i, s.pk_q, s.pk_d, s.wave, n.dom, n.cov, n.idx + 1 < {rules.window} AS early,
                       CASE s.side WHEN 'BUY' THEN n.buy ELSE n.sell END AS qty, CASE s.side WHEN 'BUY' THEN n.sell ELSE n.buy END AS oth, CASE s.side WHEN 'BUY' THEN n.dom ELSE -n.dom END AS same,
                       CASE WHEN n.cov >= {rules.coverage} THEN CASE WHEN n.dom >= {rules.activate} THEN 'BUY' WHEN n.dom <= -{rules.activate} THEN 'SELL' END END AS lside, CASE WHEN n.dom > 0 THEN n.buy ELSE n.sell END AS lqty
                FROM {name}_s s JOIN {name}_b n ON n.symbol = s.symbol AND n.start = s.start AND n.idx = s.idx + 1)))))
)""",
        f"""{name} AS MATERIALIZED (
  SELECT symbol, start, wave - 1 AS wave, e_side AS side, e_s0 AS start_idx, e_pk_i AS peak_idx, e_pk_q AS peak_qty, e_pk_d AS peak_dominance, idx AS end_idx, e_type AS termination, e_qty AS end_side_qty,
         e_oth AS end_opposite_qty, e_cov AS end_coverage, e_dom AS end_dominance, e_decay AS pressure_decay, p AS end_price, idx AS last_idx
  FROM {name}_s JOIN {name}_b USING (symbol, start, idx) WHERE e_side IS NOT NULL
  UNION ALL SELECT symbol, start, wave, side, s0, pk_i, pk_q, pk_d, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, idx
  FROM {name}_s WHERE side IS NOT NULL AND idx = (SELECT max(idx) FROM {name}_b b WHERE b.symbol = {name}_s.symbol AND b.start = {name}_s.start)
)""",
    ]


def with_waves(waves_: str) -> str:
    """The hypotheses with the evidence of waves, as ``hypw``."""
    out = HYPOTHESES.replace("hyp AS (", "hypw AS (", 1)
    joined = f"""LEFT JOIN (SELECT symbol, start, max(end_price) FILTER (WHERE end_idx IS NOT NULL AND side = 'BUY') AS be, min(end_price) FILTER (WHERE end_idx IS NOT NULL AND side = 'SELL') AS se,
    max(side) FILTER (WHERE end_idx IS NULL) AS open_side FROM {waves_} GROUP BY ALL) wz USING (symbol, start),
  LATERAL (SELECT h - l AS sp"""
    out = out.replace(",\n  LATERAL (SELECT h - l AS sp", "\n  " + joined, 1)
    out = out.replace("* 0.20) + 0.10 WHERE (h - greatest(o, c.c)) / greatest(sp, 1) >= 0.25 AND nh", "* 0.20) + 0.10 * CAST(coalesce(nh, false) AS INTEGER) + 0.10 * CAST(coalesce(h - be <= 2, false) AS INTEGER) WHERE (h - greatest(o, c.c)) / greatest(sp, 1) >= 0.25 AND (coalesce(nh, false) OR coalesce(h - be <= 2, false))")
    out = out.replace("* 0.20) + 0.10 WHERE (least(o, c.c) - l) / greatest(sp, 1) >= 0.25 AND nl", "* 0.20) + 0.10 * CAST(coalesce(nl, false) AS INTEGER) + 0.10 * CAST(coalesce(se - l <= 2, false) AS INTEGER) WHERE (least(o, c.c) - l) / greatest(sp, 1) >= 0.25 AND (coalesce(nl, false) OR coalesce(se - l <= 2, false))")
    held = "UNION ALL SELECT 'ONDA_ABERTA_SUSTENTA_FECHAMENTO', 0.62 + 0.15 * coverage WHERE open_side = 'BUY' AND (c.c > o OR zone = 'TOPO') OR open_side = 'SELL' AND (c.c < o OR zone = 'FUNDO')\n    "
    out = out.replace("UNION ALL SELECT 'DISPUTA_EQUILIBRADA'", held + "UNION ALL SELECT 'DISPUTA_EQUILIBRADA'", 1)
    return out.replace("SELECT c.symbol, c.start, x.code, x.score FROM", "SELECT c.symbol, c.start, x.code, x.score, wz.open_side FROM", 1)


def clusters(paths: str) -> list[str]:
    """Lloyd's rounds by recursion: ``sg`` (vectors), ``seed_s`` (the first centroids), ``ll_s`` (the rounds), ``km`` (clusters)."""
    near = "list_transform({0}, lambda c: round(list_distance(c, vec) / sqrt(len(vec)), 12))"
    return [
        paths,
        f"""sg AS MATERIALIZED (
  SELECT symbol, start, list_concat(v, [directional_efficiency, range_efficiency, least(reversal_rate, 1.0), least(revisit_rate, 1.0), least(time_to_high_ms / {N * 1000.0}, 1.0), least(time_to_low_ms / {N * 1000.0}, 1.0)]) AS vec
  FROM (SELECT symbol, start, list(CASE WHEN x0 IS NULL OR px >= x THEN y ELSE y0 + (y - y0) * ((px - x0) / (x - x0)) END ORDER BY point) AS v FROM xz JOIN grid ON (x0 IS NULL OR px > x0) AND (x1 IS NULL OR px <= x) GROUP BY symbol, start)
  JOIN dna USING (symbol, start)
)""",
        "many AS (SELECT greatest(1, least(greatest(2, least(8, CAST(round_even(sqrt(count(*)), 0) AS BIGINT))), count(*))) AS k FROM sg)",
        f"""seed_s AS (
  SELECT 1 AS i, [arg_min(vec, (start, symbol))] AS cs FROM sg
  UNION ALL SELECT i + 1, list_append(any_value(cs), arg_min(vec, (-d, start, symbol))) FROM (SELECT i, cs, vec, start, symbol, list_min({near.format('cs')}) AS d FROM seed_s, sg WHERE i < (SELECT k FROM many)) GROUP BY i
)""",
        f"""ll_s AS (
  SELECT 0 AS i, cs, false AS done FROM seed_s WHERE i = (SELECT k FROM many)
  UNION ALL
  SELECT i + 1, fresh, fresh = cs FROM (
    SELECT i, any_value(cs) AS cs, list(coalesce(mean, cs[j]) ORDER BY j) AS fresh FROM (
      SELECT g.i, g.cs, g.j, m.mean FROM (SELECT i, cs, unnest(range(1, len(cs) + 1)) AS j FROM ll_s WHERE NOT done AND i < 80) g
      LEFT JOIN (SELECT j, list(a ORDER BY d) AS mean FROM (SELECT j, d, round(avg(vec[d]), 12) AS a FROM (SELECT vec, list_position(ds, list_min(ds)) AS j FROM (SELECT vec, {near.format('cs')} AS ds FROM ll_s, sg WHERE NOT done AND i < 80)), range(1, 32) r(d) GROUP BY j, d) GROUP BY j) m ON m.j = g.j
    ) GROUP BY i)
)""",
        f"""km AS MATERIALIZED (
  SELECT symbol, start, CAST(list_position(ds, list_min(ds)) AS INTEGER) AS cluster, list_min(ds) AS distance FROM (SELECT symbol, start, {near.format('cs')} AS ds FROM sg, (SELECT list_sort(arg_max(cs, i)) AS cs FROM ll_s))
)""",
    ]
