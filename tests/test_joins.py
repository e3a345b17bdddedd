"""Interval joins, agents' profiles and calibration against brute force."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest

from tests.helpers import trades
from tickloom.operators import agents, calibrate, intervals


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_of_any_length(spark, seed):
    rng = random.Random(seed)

    def some(n, name):
        out = []
        for i in range(n):
            a = rng.randrange(-5_000, 2_000_000)
            length = rng.choice([0, 1, rng.randrange(1, 900), rng.randrange(1, 50_000), rng.randrange(1, 5_000_000), -3])
            out.append((rng.choice("xy"), f"{name}{i}", a, a + length))
        return [*out, ("x", f"{name}null", None, 5), ("z", f"only {name}", 0, 10**15)]

    left, right = some(60, "l"), some(60, "r")
    # borders of buckets, equal intervals, and ones that touch
    left += [("x", "lb", 4_000, 8_000), ("x", "le", 1_000, 2_000)]
    right += [("x", "rb", 8_000, 9_000), ("x", "re", 1_000, 2_000), ("x", "rt", 2_000, 3_000)]
    a = spark.createDataFrame(left, "k string, l string, a long, b long")
    b = spark.createDataFrame(right, "k string, r string, c long, d long")
    out = intervals.overlap_join(a, b, ["k"], ("a", "b"), ("c", "d"))
    assert out.columns == ["k", "l", "a", "b", "r", "c", "d", "overlap_from", "overlap_to"]
    got = sorted((r.l, r.r, r.overlap_from, r.overlap_to) for r in out.collect())
    real = lambda rows: [r for r in rows if r[2] is not None and r[2] < r[3]]
    want = sorted((x[1], y[1], max(x[2], y[2]), min(x[3], y[3])) for x in real(left) for y in real(right) if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert got == want and len(want) > 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.overlap_join(a.limit(0), b, ["k"], ("a", "b"), ("c", "d")).count() == 0


def test_concentration(spark):
    t = trades(spark, [(1, 100, 30, "BUY", "A"), (2, 100, 10, "BUY", "B"), (3, 101, 60, "BUY", ""), (4, 101, 5, "SELL", "C"), (5, 101, 7, "SELL", " "), (6, 101, 9, "NONE", "D")])
    got = {r.side: r for r in agents.concentration(t, 60).collect()}
    assert set(got) == {"BUY", "SELL"} and got["BUY"].agents == 2 and got["BUY"].quantity == 100
    assert got["BUY"].hhi == pytest.approx(0.625) and got["BUY"].effective_agents == pytest.approx(1.6) and got["BUY"].top_share == 0.75 and got["BUY"].named_share == 0.4
    assert got["SELL"].hhi == 1 and got["SELL"].named_share == pytest.approx(5 / 12)
    assert agents.concentration(t, 60, by_level=True).count() == 2


def test_profile_matches_are_the_brute_force_ones(spark):
    rng = random.Random(6)
    rows = []
    for day in range(3):
        for agent in "ABCDE":
            home = 100 + 40 * (ord(agent) % 3)
            rows += [(day * 86_400 + rng.randrange(3_000), home + rng.randrange(30), 1, "BUY" if agent < "C" else "SELL", agent) for _ in range(25)]
    t = trades(spark, rows)
    items = defaultdict(set)
    for r in agents.profiles(t, 3600, 10, 2).collect():
        items[r.session_date, r.agent].add(r.item)
    days = sorted({d for d, _ in items})
    want = set()
    for d, e in zip(days, days[1:]):
        for (d1, a), x in items.items():
            for (d2, b), y in items.items():
                if d1 == d and d2 == e and len(x & y) / len(x | y) >= 0.5:
                    want.add((d, e, a, b, len(x & y)))
    got = agents.profile_matches(t, 3600, 10, 2).collect()
    assert {(r.session_date, r.next_date, r.agent, r["match"], r.common) for r in got} == want and want
    assert all(r.same_agent == (r.agent == r["match"]) for r in got)


def pav(points):
    """Pool adjacent violators over (bin, n, hits)."""
    blocks = []
    for b, n, h in points:
        blocks.append([[b], n, h])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return {b: h / n for bins, n, h in blocks for b in bins}


def test_walk_forward_fits_earlier_sessions_only(spark):
    rng = random.Random(4)
    day = date(2026, 1, 5)
    rows = [("c", day + timedelta(days=k // 30), s := rng.random(), rng.random() < s * s) for k in range(240)] + [("c", day, None, True), ("d", day, 1.0, True), ("c", day, 0.5, None)]
    df = spark.createDataFrame(rows, "code string, session_date date, score double, hit boolean")
    got = {(r.code, r.session_date, r.bin): r for r in calibrate.walk_forward(df, ["code"], 10).collect()}
    seen = 0
    for d in sorted({r[1] for r in rows}):
        past = defaultdict(lambda: [0, 0])
        for c, e, s, h in rows:
            if c == "c" and e < d and s is not None and h is not None:
                past[min(9, int(s * 10 + 1e-9))][0] += 1
                past[min(9, int(s * 10 + 1e-9))][1] += h
        fit = pav([(b, n, h) for b, (n, h) in sorted(past.items())])
        for (c, e, b), r in got.items():
            if c == "c" and e == d:
                assert r.seen == sum(n for n, _ in past.values())
                if b in fit:
                    assert r.calibrated == pytest.approx(fit[b])
                    seen += 1
                elif not past:
                    assert r.calibrated is None
    assert seen > 40 and got["d", day, 9].n == 1
    # a later session changes nothing before it
    cut = day + timedelta(days=5)
    before = {k: tuple(r) for k, r in got.items() if k[1] < cut}
    assert before == {(r.code, r.session_date, r.bin): tuple(r) for r in calibrate.walk_forward(df.filter(df.session_date < cut), ["code"], 10).collect()}
