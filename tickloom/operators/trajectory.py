"""Normalised paths, rule families, and deterministic clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import CANDLE, in_candle, indexed, indexed_once, when_chain, whole_candle
from .dna import candle_dna

POINTS = 25


def trajectory_path(trades: DataFrame, interval: int, points: int = POINTS) -> DataFrame:
    """Each candle's price path over [0, 1] x [0, 1] at ``points`` even places, linear between trades."""
    if points < 3:
        raise ValueError("points must be 3 or more")
    c = F.col
    w, whole = in_candle(), whole_candle()
    t = indexed(trades, interval).withColumns({"lo": F.min("price_ticks").over(whole), "hi": F.max("price_ticks").over(whole)})
    t = t.withColumns(
        {
            "x": F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c("us") - c("start") * 1_000_000) / (interval * 1e6))),
            "y": F.when(c("hi") > c("lo"), (c("price_ticks") - c("lo")) / (c("hi") - c("lo"))).otherwise(0.5),
        }
    )
    # of trades at one time the last counts
    t = t.withColumn("next_x", F.lead("x").over(w)).filter(c("next_x").isNull() | (c("next_x") != c("x")))
    w = Window.partitionBy(*CANDLE).orderBy("x")
    t = t.withColumns({"x0": F.lag("x").over(w), "y0": F.lag("y").over(w), "x1": F.lead("x").over(w)})
    # the places that a trade ends: from the one before (without it) up to itself; the first and last reach the borders
    step = points - 1
    low = F.when(c("x0").isNull(), 0).otherwise(F.floor(c("x0") * step) + 1)
    high = F.when(c("x1").isNull(), step).otherwise(F.floor(c("x") * step))
    t = t.withColumns({"low": low.cast("int"), "high": high.cast("int")}).filter("low <= high")
    t = t.withColumn("point", F.explode(F.sequence("low", "high"))).withColumn("px", c("point") / float(step))
    y = F.when(c("x0").isNull() | (c("px") >= c("x")), c("y")).otherwise(c("y0") + (c("y") - c("y0")) * ((c("px") - c("x0")) / (c("x") - c("x0"))))
    return t.select(*CANDLE, "point", y.alias("y"))


def rule_family(trades: DataFrame, interval: int, dna: DataFrame | None = None) -> DataFrame:
    """The first rule that a candle fits, and its confidence. ``dna``: that of the same trades, where it is there already."""
    c = F.col
    if dna is None:
        trades = indexed_once(trades, interval)
        dna = candle_dna(trades, interval)
    half = F.floor(c("n") / 2)
    t = indexed(trades, interval).withColumn("n", F.count("*").over(whole_candle()))
    g = t.groupBy(*CANDLE).agg(
        F.min_by("price_ticks", "idx").alias("o"),
        F.max_by("price_ticks", "idx").alias("c"),
        F.max("price_ticks").alias("hi"),
        F.min("price_ticks").alias("lo"),
        F.min(F.when(c("idx") <= half, c("price_ticks"))).alias("half_lo"),
        F.max(F.when(c("idx") <= half, c("price_ticks"))).alias("half_hi"),
    )
    d = dna.select(*CANDLE, c("directional_efficiency").alias("de"), c("reversal_rate").alias("rr"), (c("high_first") == "HIGH_FIRST").alias("high_first"), (c("high_first") == "LOW_FIRST").alias("low_first"))
    g = g.join(d, CANDLE).withColumn("rng", c("hi") - c("lo"))
    o, cl, hi, lo, rng, de, rr = (c(x) for x in ("o", "c", "hi", "lo", "rng", "de", "rr"))
    up, down = cl > o, cl < o
    near_hi, near_lo = hi - 0.15 * rng, lo + 0.15 * rng
    one = F.lit(1.0)
    rules = [
        ("FLAT", rng == 0, one),
        ("SWEEP_LOW_REVERSAL", (lo < o) & c("low_first") & up & ((cl - lo) / rng >= 0.65), F.least(one, 0.55 + 0.35 * (cl - lo) / rng)),
        ("SWEEP_HIGH_REVERSAL", (hi > o) & c("high_first") & down & ((hi - cl) / rng >= 0.65), F.least(one, 0.55 + 0.35 * (hi - cl) / rng)),
        ("DIRECT_IMPULSE_UP", up & (de >= 0.55) & (cl >= near_hi), F.least(one, 0.55 + 0.45 * de)),
        ("DIRECT_IMPULSE_DOWN", down & (de >= 0.55) & (cl <= near_lo), F.least(one, 0.55 + 0.45 * de)),
        ("V_SHAPED", (c("half_lo") <= near_lo) & (cl >= o) & c("low_first"), F.lit(0.65)),
        ("INVERTED_V", (c("half_hi") >= near_hi) & (cl <= o) & c("high_first"), F.lit(0.65)),
        ("DOUBLE_EXCURSION", (hi > o) & (lo < o) & (rr >= 0.25), F.least(one, 0.55 + rr / 2)),
        ("PULLBACK_CONTINUATION_UP", up & (o > lo), F.lit(0.58)),
        ("PULLBACK_CONTINUATION_DOWN", down & (hi > o), F.lit(0.58)),
        ("OSCILLATING_RANGE", (rr >= 0.20) | (de <= 0.25), F.least(one, 0.55 + (1 - de) * 0.3)),
    ]
    family = when_chain(*[(cond, name) for name, cond, _ in rules], default="UNCLASSIFIED")
    confidence = when_chain(*[(cond, conf) for _, cond, conf in rules], default=0.35)
    return g.select(*CANDLE, family.alias("family"), confidence.alias("confidence"))


def eligible_families(families: DataFrame, index: DataFrame) -> DataFrame:
    """Families without the candles whose session isn't eligible; a candle that the index doesn't have stays."""
    gate = index.select(*CANDLE, F.col("eligible").alias("_eligible"))
    return families.join(gate, CANDLE, "left").filter(F.coalesce("_eligible", F.lit(True))).drop("_eligible")


def family_share(families: DataFrame) -> DataFrame:
    g = families.groupBy("symbol", "family").agg(F.count("*").alias("count"))
    return g.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("symbol")))


def signatures(trades: DataFrame, interval: int, points: int = POINTS) -> DataFrame:
    """``vector``: the path and six DNA features clipped to 1."""
    trades = indexed_once(trades, interval)
    path = trajectory_path(trades, interval, points).groupBy(*CANDLE).agg(F.transform(F.array_sort(F.collect_list(F.struct("point", "y"))), lambda x: x["y"]).alias("path"))
    c = F.col
    clip = lambda x: F.least(x, F.lit(1.0))
    ms = interval * 1000.0
    d = candle_dna(trades, interval).select(*CANDLE, F.array(c("directional_efficiency"), c("range_efficiency"), clip(c("reversal_rate")), clip(c("revisit_rate")), clip(c("time_to_high_ms") / ms), clip(c("time_to_low_ms") / ms)).alias("dna"))
    return path.join(d, CANDLE).select(*CANDLE, F.concat("path", "dna").alias("vector"))


def _nearest(vectors: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """Adds ``best`` (d, j): the nearest centroid by root mean square, the lowest of equal ones.

    The centroids come as one broadcast row, so that each round runs the same compiled plan."""
    row = vectors.sparkSession.createDataFrame([([[float(x) for x in c] for c in centroids],)], "_centroids array<array<double>>")
    squares = lambda c: F.aggregate(F.zip_with("vector", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    found = F.transform("_centroids", lambda c, j: F.struct(F.round(F.sqrt(squares(c) / F.size(c)), 12).alias("d"), j.alias("j")))
    return vectors.crossJoin(F.broadcast(row)).withColumn("best", F.array_min(found)).drop("_centroids")


def kmeans(vectors: DataFrame, k: int | None = None, max_iter: int = 80) -> tuple[DataFrame, list[list[float]]]:
    """(vectors with ``cluster`` 1..k and ``distance``, centroids) by Lloyd's rounds in Spark.

    Centroids start at the first vector (by start, symbol), then always at the one farthest from those
    chosen; ties go to the lowest number; an empty cluster keeps its centroid. Each round is one
    scan and one aggregation; only the k centroids (k <= 8 unless given) pass through the driver.
    """
    v = vectors.persist()
    n = v.count()
    if not n:
        v.unpersist()
        return vectors.select("*", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("distance")), []
    k = max(1, min(k or max(2, min(8, round(n**0.5))), n))
    centroids = [list(v.orderBy("start", "symbol").first()["vector"])]
    while len(centroids) < k:
        centroids.append(list(_nearest(v, centroids).orderBy(F.desc("best.d"), "start", "symbol").first()["vector"]))
    dims = len(centroids[0])
    for _ in range(max_iter):
        rows = _nearest(v, centroids).groupBy("best.j").agg(*[F.round(F.avg(F.col("vector")[d]), 12).alias(f"d{d}") for d in range(dims)]).collect()  # k rows
        found = {r["j"]: [r[f"d{d}"] for d in range(dims)] for r in rows}
        new = [found.get(j, x) for j, x in enumerate(centroids)]
        if new == centroids:
            break
        centroids = new
    centroids = sorted(centroids)
    v.unpersist()
    out = _nearest(vectors, centroids).select(*vectors.columns, (F.col("best.j") + 1).alias("cluster"), F.col("best.d").alias("distance"))
    return out, centroids


def cluster_summary(clustered: DataFrame, families: DataFrame) -> DataFrame:
    """Size, cohesion, medoid and dominant rule family of each cluster; empty clusters have no row."""
    x = clustered.join(families, CANDLE)
    sizes = x.groupBy("cluster").agg(F.count("*").alias("size"), F.round(F.avg("distance"), 6).alias("cohesion"), F.min_by(F.struct(*CANDLE), F.struct("distance", "start", "symbol")).alias("medoid"))
    by = x.groupBy("cluster", "family").agg(F.count("*").alias("n"), F.min("start").alias("first"))
    top = by.groupBy("cluster").agg(F.max_by("family", F.struct("n", -F.col("first"))).alias("dominant_rule"), F.max("n").alias("n"))
    return sizes.join(top, "cluster").select("cluster", "size", "cohesion", "dominant_rule", (F.col("n") / F.col("size")).alias("dominance"), F.col("medoid.symbol").alias("medoid_symbol"), F.col("medoid.start").alias("medoid_start"))
