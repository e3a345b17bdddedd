"""Scores turned into probabilities by isotonic regression on earlier sessions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Scores are counted by so many equal bins over [0, 1].
BINS = 20


def walk_forward(scored: DataFrame, keys: list[str], bins: int = BINS, least: int = 1) -> DataFrame:
    """``scored`` has keys, session_date, score in [0, 1] and hit (boolean). One row for each session and bin that has scores: their number ``n``
    and ``hits``, and ``calibrated``, the value at the bin of the isotonic fit to all scores of earlier sessions, with ``seen``, how many those are; null with fewer than ``least``.

    Scores are counted by bin, then summed over earlier sessions, so a fit sees one row of ``bins`` counts, whatever the number of scores. The isotonic fit at bin i is the largest, over a <= i,
    of the smallest mean, over b >= i, of the bins a to b. Null scores and hits are left out.
    """
    c = F.col
    bin_ = F.least(F.floor(c("score") * bins + 1e-9), F.lit(bins - 1)).cast("int")
    days = scored.filter("score IS NOT NULL AND hit IS NOT NULL").groupBy(*keys, "session_date", bin_.alias("bin")).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    row = lambda x: F.array(*[F.coalesce(F.sum(F.when(c("bin") == k, c(x))), F.lit(0)) for k in range(bins)])
    wide = days.groupBy(*keys, "session_date").agg(row("n").alias("n"), row("hits").alias("hits"))
    before = Window.partitionBy(*keys).orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)  # a row for each session
    past = lambda x: F.array(*[F.coalesce(F.sum(c(x)[k]).over(before), F.lit(0)) for k in range(bins)])
    wide = wide.withColumns({"past_n": past("n"), "past_hits": past("hits")})
    # running sums: entry k is of the bins before k
    running = lambda x: F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda k: F.aggregate(F.slice(x, 1, k), F.lit(0).cast("long"), lambda a, v: a + v))
    wide = wide.withColumns({"cn": running("past_n"), "ch": running("past_hits")})
    mean = lambda a, b: F.try_divide((F.get("ch", b + 1) - F.get("ch", a)).cast("double"), (F.get("cn", b + 1) - F.get("cn", a)).cast("double"))
    up = lambda i: F.array_max(F.transform(F.sequence(F.lit(0), i), lambda a: F.array_min(F.transform(F.sequence(i, F.lit(bins - 1)), lambda b: mean(a, b)))))
    cells = wide.withColumn("bin", F.explode(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.get("n", k) > 0)))
    seen = F.get("cn", F.lit(bins))
    return cells.select(*keys, "session_date", "bin", F.get("n", c("bin")).alias("n"), F.get("hits", c("bin")).alias("hits"), F.when(seen >= least, up(c("bin"))).alias("calibrated"), seen.alias("seen"))
