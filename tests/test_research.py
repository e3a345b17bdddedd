"""Quality, reconciliation, research, trajectories, transitions, validation and simulation."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import T0, one, priced, trades
from tickloom.operators import quality, reconcile, research, simulate, trajectory, transitions, validation
from tickloom.operators.candles import build_candles
from tickloom.schema import REFERENCES


def references(spark, trades_, interval=60, **plus):
    c = build_candles(trades_, interval)
    out = c.withColumns({"interval_seconds": F.lit(interval), "source": F.lit("ref")})
    for k, v in plus.items():
        out = out.withColumn(k, F.col(k) + v)
    return out.select(*REFERENCES.fieldNames())


def test_reconcile(spark):
    t = priced(spark, [100, 101]).unionAll(priced(spark, [102, 103], T0 + timedelta(minutes=2)))
    refs = references(spark, t)
    assert {r.status for r in reconcile.reconcile(t, refs, 60).collect()} == {"EXACT"}
    assert {r.status for r in reconcile.reconcile(t, references(spark, t, high_ticks=1), 60).collect()} == {"MISMATCH"}
    assert {r.status for r in reconcile.reconcile(t, references(spark, t, volume=1), 60).collect()} == {"OHLC_MATCH"}
    gap = refs.unionByName(refs.limit(1).withColumn("start", F.lit(int(T0.timestamp()) + 60).cast("long")))
    extra = references(spark, priced(spark, [1, 2], T0 + timedelta(minutes=1)))
    full = refs.unionByName(extra)
    assert one(reconcile.reconcile_summary(reconcile.reconcile(t, full, 60))).no_data == 1
    assert reconcile.reconcile_available(t, full, 60).count() == 2
    assert gap.count() == 3


def test_reconcile_window_border(spark):
    t = trades(spark, [(0, 100, 1, "BUY", ""), (59, 101, 1, "BUY", ""), (60, 102, 1, "BUY", "")])
    got = {r.status for r in reconcile.reconcile_window(t, references(spark, t), 60).collect()}
    assert got == {"EXACT", "PARTIAL_SOURCE_WINDOW"}


def test_quality(spark):
    t = simulate.sample_trades(spark)
    assert t.count() == 2880 and t.select("session_date").distinct().count() == 6
    q = quality.session_quality(t)
    assert q.count() == 6 and {r.schedule_id for r in q.collect()} == {"SYNTHETIC_WINLAB06_V1"}
    r = one(quality.session_quality(priced(spark, [1, 2], symbol="OTHER")))
    assert (r.status, r.score, r.eligible) == ("UNKNOWN_SCHEDULE", 50.0, False)
    assert one(quality.session_quality(priced(spark, [1], symbol="WINX26"))).status == "PARTIAL_BOTH"


def test_rule_families(spark):
    get = lambda p: one(trajectory.rule_family(priced(spark, p), 60))
    r = get(list(range(100, 111)))
    assert r.family == "DIRECT_IMPULSE_UP" and r.confidence >= 0.6
    assert get([100, 97, 94, 92, 95, 99, 103, 107, 110, 109]).family == "SWEEP_LOW_REVERSAL"
    assert get([100, 100]).family == "FLAT"


def test_path_and_kmeans(spark):
    path = [r.y for r in trajectory.trajectory_path(priced(spark, [100, 110]), 60, 5).orderBy("point").collect()]
    assert path[0] == 0 and path[-1] == 1 and path == sorted(path)
    v = spark.createDataFrame([("S", k, [x, x]) for k, x in enumerate((0.0, 0.1, 0.9, 1.0))], "symbol string, start long, vector array<double>")
    a, ca = trajectory.kmeans(v, 2)
    b, cb = trajectory.kmeans(v.orderBy(F.desc("start")), 2)
    got = [r.cluster for r in a.orderBy("start").collect()]
    assert got == [1, 1, 2, 2] == [r.cluster for r in b.orderBy("start").collect()] and ca == cb
    same = spark.createDataFrame([("S", k, [1.0, 1.0]) for k in range(3)], "symbol string, start long, vector array<double>")
    assert trajectory.kmeans(same, 2)[0].count() == 3  # duplicates leave a cluster empty


def test_transitions_need_neighbours_of_one_day(spark):
    up, down = list(range(100, 110)), list(range(110, 100, -1))
    t = priced(spark, up).unionAll(priced(spark, down, T0 + timedelta(minutes=1))).unionAll(priced(spark, up, T0 + timedelta(days=1)))
    f = trajectory.rule_family(t, 60)
    assert one(transitions.transitions(f, 60))["count"] == 1
    gap = priced(spark, up).unionAll(priced(spark, up, T0 + timedelta(minutes=2)))
    assert transitions.transitions(trajectory.rule_family(gap, 60), 60).count() == 0
    three = priced(spark, up).unionAll(priced(spark, down, T0 + timedelta(minutes=1))).unionAll(priced(spark, up, T0 + timedelta(minutes=2)))
    f = trajectory.rule_family(three, 60)
    assert one(transitions.motifs(f, 60))["count"] == 1
    s = transitions.stability(f).collect()
    assert {r.label for r in s} == {"AMOSTRA_PEQUENA"} and all(r.prevalence == 1 for r in s)


def library(spark, n, source="real", start=T0):
    rows = [(60 * k + 2 * i, 100 + 2 * k + i // 10, 2, "BUY", "A") for k in range(n) for i in range(30)]
    return trades(spark, rows, start, source=source)


def test_validation(spark):
    t = library(spark, 8)
    refs = references(spark, t)
    out = validation.hypothesis_outcomes(t, 60, [1], refs).filter("code = 'AGRESSAO_ALINHADA_ALTA' AND confidence IS NULL").first()
    assert (out.n, out.hit_rate, out.baseline_rate, out.sample_status) == (7, 1.0, 1.0, "AMOSTRA_INSUFICIENTE")
    bad = references(spark, library(spark, 5))
    first = bad.agg(F.min("start")).first()[0]
    bad = bad.withColumn("high_ticks", F.col("high_ticks") + F.when(F.col("start") == first, 1).otherwise(0))
    got = {r.reason: r.candles for r in validation.exclusions(validation.gated(library(spark, 5), 60, bad)).collect()}
    assert got == {"ELIGIBLE": 4, "REFERENCE_MISMATCH": 1}
    got = {r.reason: r.candles for r in validation.exclusions(validation.gated(library(spark, 4, "synthetic_x"), 60)).collect()}
    assert got == {"SYNTHETIC": 4}
    night = library(spark, 2).unionAll(library(spark, 1, start=T0 + timedelta(days=1)))
    assert one(validation.direction_baseline(validation.gated(night, 60), 60, [1])).eligible == 1


def test_similarity(spark):
    t = library(spark, 3).unionAll(library(spark, 3, start=T0 + timedelta(days=1)))
    index = research.research_index(t, 60)
    target = index.orderBy("start").limit(1)
    for kind in ("visual", "dna", "structural"):
        got = research.similar(index, target, kind, 2).collect()
        assert len(got) == 2 and got[0].score >= got[1].score > 90
    assert research.similar(index, target, "visual", quality_only=True).count() == 0


def test_counterfactual(spark):
    c = build_candles(priced(spark, [100, 110, 95, 108]), 60)
    r = one(simulate.counterfactual_paths(c, 40))
    p = r.prices
    assert (p[0], p[-1], max(p), min(p), len(p), r.label) == (100, 108, 110, 95, 40, "SIMULATED")
    assert one(simulate.counterfactual_paths(c, 40)) == r
    assert one(simulate.counterfactual_paths(c, 40, seed=7)).prices != p and max(abs(a - b) for a, b in zip(p, p[1:])) <= 15
    with pytest.raises(ValueError):
        simulate.counterfactual_paths(c, 3)
    with pytest.raises(Exception, match="inconsistent OHLC"):
        simulate.counterfactual_paths(c.withColumn("high_ticks", F.lit(90).cast("long"))).collect()
