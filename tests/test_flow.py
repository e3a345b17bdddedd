"""Candles, DNA, aggression, efficiency, paradoxes, waves and interpretation on small fixtures."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import T0, one, priced, trades
from tickloom.operators import aggression, candles, dna, efficiency, interpret, waves
from tickloom.operators.waves import WaveRules

A1 = [(1, 100, 80, "BUY", "A"), (2, 100, 40, "BUY", "A"), (3, 100, 20, "SELL", "S1"), (10, 101, 30, "BUY", "B"), (20, 102, 12, "SELL", "S2"), (30, 103, 5, "BUY", "C")]


def test_candle_and_rollup(spark):
    t = priced(spark, [100, 105, 95, 102]).unionAll(priced(spark, [103, 99], T0 + timedelta(minutes=1)))
    c = candles.build_candles(t, 60).orderBy("start").collect()
    assert [tuple(c[0])[2:8], c[1].open_ticks] == [(100, 105, 95, 102, 4, 4), 103]
    a = candles.roll_up(candles.build_candles(t, 60), 300).select("symbol", "start", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "trades").collect()
    b = candles.build_candles(t, 300).select("symbol", "start", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "trades").collect()
    assert a == b
    with pytest.raises(ValueError):
        candles.build_candles(t, 0)


def test_order_is_total_and_input_order_does_not_matter(spark):
    t = trades(spark, [(0, p, 1, "BUY", "A") for p in (5, 3, 9, 4)])
    r = one(candles.build_candles(t.orderBy(F.rand(3)), 60))
    assert (r.open_ticks, r.close_ticks) == (5, 4)
    last = t.withColumn("sequence_no", F.when(F.col("price_ticks") == 5, F.lit(None)).otherwise(F.col("sequence_no")))
    assert one(candles.build_candles(last, 60)).close_ticks == 5  # no sequence number: last


def test_dna_against_brute_force(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 40):
        p = [100 + rng.randrange(-3, 4) for _ in range(n)]
        r = one(dna.candle_dna(priced(spark, p), 60))
        d = [b - a for a, b in zip(p, p[1:])]
        s = [x > 0 for x in d if x]
        seen, revisits = {p[0]}, 0
        for a, b in zip(p, p[1:]):
            if a != b:
                revisits += b in seen
                seen.add(b)
        assert r.path_distance_ticks == sum(map(abs, d)) and r.reversals == sum(a != b for a, b in zip(s, s[1:]))
        assert r.total_revisits == revisits and r.unique_prices == len(set(p))
        assert r.max_drawdown_ticks == max(max(p[: i + 1]) - x for i, x in enumerate(p))
        assert r.high_visits == sum(x == max(p) and (i == 0 or p[i - 1] != x) for i, x in enumerate(p))


def test_levels_agents_and_summary(spark):
    t = trades(spark, A1)
    f = one(aggression.candle_flow(t, 60))
    assert (f.buy, f.sell, f.delta) == (155, 32, 123)
    top = aggression.top_agents(t, 60).filter("side = 'BUY' AND rank = 1").first()
    assert (top.agent, top.quantity) == ("A", 120)
    lv = {r.price_ticks: r for r in aggression.level_aggression(t, 60).collect()}
    assert (lv[100].buy, lv[100].sell) == (120, 20) and lv[100].dominance > 0.70 and lv[100].intensity in ("ALTA", "EXTREMA")
    assert sum(r.volume for r in lv.values()) == f.volume
    assert abs(sum(f[f"{x}_share_volume"] for x in ("buy", "sell", "rlp", "unknown")) - 1) < 1e-9


def test_rlp_is_neither_side(spark):
    f = one(aggression.candle_flow(trades(spark, [(0, 200, 50, "SELL", "X"), (1, 200, 25, "RLP", ""), (2, 201, 10, "NONE", "")]), 60))
    assert (f.sell, f.rlp, f.unknown, f.directed) == (50, 25, 10, 50) and f.coverage == pytest.approx(50 / 85)


def test_divergence_and_responses(spark):
    f = one(aggression.candle_flow(trades(spark, [(1, 102, 60, "BUY", "A"), (2, 101, 30, "BUY", "A"), (3, 100, 20, "SELL", "B"), (4, 99, 10, "RLP", "")]), 60))
    assert (f.relation, f.direction, f.price_direction) == ("DIVERGENTE", "COMPRA", "BAIXA") and f.priority in ("MODERADA", "ALTA")
    lv = aggression.level_aggression(trades(spark, [(1, 100, 100, "BUY", ""), (2, 100, 100, "BUY", ""), (3, 101, 5, "SELL", ""), (4, 100, 10, "BUY", ""), (5, 99, 5, "SELL", "")]), 60)
    assert lv.filter("price_ticks = 100").first().response == "POSSIVEL_ABSORCAO"
    lv = aggression.level_aggression(trades(spark, [(0, 100, 5, "SELL", ""), (1, 101, 100, "BUY", ""), (2, 101, 100, "BUY", "")]), 60)
    r = lv.filter("price_ticks = 101").first()
    assert (r.response, r.future) == ("SEM_JANELA_POS_AGRESSAO", 0)


@pytest.mark.parametrize("n,sizes", [(1, [1]), (2, [1, 1]), (4, [1, 1, 2]), (10, [3, 3, 4]), (11, [3, 4, 4])])
def test_phase_sizes(spark, n, sizes):
    got = efficiency.flow_phases(priced(spark, [100] * n), 60).orderBy("phase_no").collect()
    assert [r.trades for r in got] == sizes


def test_effort_decay_and_paradox(spark):
    rows = []
    for i in range(30):
        price = [100, 101, 102, 103, 104, 105, 105, 105, 105, 105][i] if i < 10 else 105 if i < 20 else 105 - (i - 20) // 2
        rows.append((i, price, 10 if i < 10 else 25 if i < 20 else 20, "BUY", "A"))
    t = trades(spark, rows)
    phases = efficiency.flow_phases(t, 60)
    assert phases.count() == 3 and efficiency.effort_events(phases).count() >= 1
    assert [r.code for r in efficiency.efficiency_decay(phases).collect()] == ["PERDA_EFICIENCIA_BUY"]
    assert efficiency.paradox_scan(t, 60).count() == 1
    fall = [105, 104, 104, 103, 103, 102, 102, 101, 101, 100, 100, 99]
    t = trades(spark, [(i, p, 20 if i < 9 else 5, "BUY" if i < 9 else "SELL", "A") for i, p in enumerate(fall)])
    assert "BAIXA_COM_COMPRA_AGRESSORA_DOMINANTE" in {r.code for r in efficiency.paradox_flags(t, 60).collect()}
    t = trades(spark, [(i, 110 - i, 20, "BUY" if i == 0 else "RLP", "A") for i in range(10)])
    assert efficiency.paradox_flags(t, 60).count() == 0  # coverage under 30 %


SMALL = WaveRules(window=5, confirm_start=2, confirm_end=2)
W1 = [(i, 100 + i // 3, 10, "BUY", "BUYER_A") for i in range(10)] + [(10 + i, 103, 10, "NONE", "") for i in range(8)]


def test_wave_exhaustion_handoff_and_causality(spark):
    first = waves.waves(trades(spark, W1), 60, SMALL).orderBy("wave").first()
    assert (first.side, first.termination) == ("BUY", "EXAUSTAO") and first.pressure_decay > 0.5
    assert waves.wave_agents(trades(spark, W1), 60, SMALL).first().agent == "BUYER_A"
    later = trades(spark, W1 + [(20 + i, 102 - i, 10, "SELL", "S") for i in range(8)])
    again = waves.waves(later, 60, SMALL).orderBy("wave").first()
    assert (again.end_idx, again.termination) == (first.end_idx, first.termination)
    post = waves.wave_post_event(trades(spark, W1 + [(20 + i, 102 - i, 10, "SELL", "S") for i in range(6)]), 60, SMALL).filter("wave = 0").first()
    assert post.outcome == "REVERSAO_COMPATIVEL"
    hand = trades(spark, [(i, 100, 10, "BUY", "B") for i in range(10)] + [(10 + i, 100, 100, "SELL", "S") for i in range(10)])
    r = waves.waves(hand, 60, WaveRules(window=5, takeover=0.40, confirm_end=2)).orderBy("wave").first()
    assert r.termination == "TROCA_CONTROLE" and r.end_dominance < 0


def test_waves_of_every_prefix_agree(spark):
    rng = random.Random(9)
    rows = [(i, 100 + rng.randrange(3), rng.randrange(1, 20), rng.choice(["BUY"] * 4 + ["SELL", "NONE"]) if i % 40 < 20 else rng.choice(["SELL"] * 3 + ["BUY", "RLP"]), "A") for i in range(120)]
    full = waves.waves(trades(spark, rows), 3600, SMALL).orderBy("wave").collect()
    assert full
    for n in (60, 90):
        part = waves.waves(trades(spark, rows[:n]), 3600, SMALL).orderBy("wave").collect()
        assert part == [r for r in full if r.end_idx < n]


def test_interpretation(spark):
    up = trades(spark, [(i, 100 + i // 2, 10, "BUY", "A") for i in range(12)])
    assert interpret.hypotheses(up, 60).filter("rank = 1 OR code = 'AGRESSAO_ALINHADA_ALTA'").count() >= 1
    assert one(interpret.geometry(up, 60)).direction == "ALTA"
    mixed = trades(spark, [(i, 100 + i // 2, 10, "SELL" if i < 9 else "BUY", "A") for i in range(12)])
    assert "ALTA_COM_DELTA_VENDEDOR" in {r.code for r in interpret.hypotheses(mixed, 60).collect()}
    few = trades(spark, [(i, 100, 10, "BUY" if i < 3 else "RLP", "A") for i in range(30)])
    assert one(interpret.evidence_quality(few, 60)).label == "LIMITADA"
    none = trades(spark, [(i, 100 + i, 10, "NONE", "") for i in range(12)])
    assert one(interpret.evidence_quality(none, 60)).label == "INDISPONIVEL"
    told = {r.code: r for r in interpret.facts(none, 60).collect()}
    assert set(told) == {"GEOMETRIA", "AGRESSAO_TOTAL", "COMPOSICAO_AGRESSAO", "EFICIENCIA_FLUXO"}
    assert told["AGRESSAO_TOTAL"].detail == "false" and told["EFICIENCIA_FLUXO"].b is None  # unavailable isn't zero


def test_two_symbols_are_two_runs(spark):
    a, b = priced(spark, [1, 5, 2], symbol="A"), priced(spark, [9, 9, 3], symbol="B")
    both = dna.candle_dna(a.unionAll(b), 60).orderBy("symbol").collect()
    assert both == [one(dna.candle_dna(a, 60)), one(dna.candle_dna(b, 60))]
