"""Joins of intervals of any length by equality, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import CANDLE, indexed, micros
from .waves import RULES, WaveRules, all_waves

#: Buckets of level k are BASE * 4**k long; the last level's are longer than any interval of a 64-bit clock.
BASE, LEVELS = 1_000, 27


def _level(length: Column) -> Column:
    """The lowest level whose buckets are at least as long, so that an interval is in two buckets of it at most."""
    out = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        out = F.when(length <= BASE * 4**k, k).otherwise(out)
    return out


def _bucketed(df: DataFrame, level: Column) -> DataFrame:
    """A row for each bucket of ``level`` that an interval meets."""
    width = F.lit(BASE) * F.pow(F.lit(4), F.col("_at")).cast("long")
    first, last = F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width)
    return df.withColumn("_at", level).withColumns({"_first": first.cast("long"), "_bucket": F.explode(F.sequence(first.cast("long"), last.cast("long")))})


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose intervals [from, to) overlap, each once, with ``overlap_from`` and ``overlap_to``.

    Each pair meets on the level of its longer interval: there the longer one is in two buckets at most, and the shorter one too. Shorter intervals are
    put only on levels that the other side's own intervals have. A pair that shares two buckets is kept in the first. Intervals that are empty or have a null end meet none.
    Other columns must differ in name.
    """
    c = F.col
    sides = []
    for df, (a, b) in ((left, left_ends), (right, right_ends)):
        rows = df.withColumns({"_from": c(a).cast("long"), "_to": c(b).cast("long")}).filter("_from < _to")
        sides.append(rows.withColumn("_own", _level(c("_to") - c("_from"))))
    levels = [sorted(r["_own"] for r in df.select("_own").distinct().collect()) for df in sides]  # at most LEVELS + 1 numbers each

    def meet(longer: DataFrame, shorter: DataFrame, on: list[int], equal: bool) -> DataFrame:
        """Pairs whose level is that of ``longer``; ``equal``: with those of the same level."""
        at = F.explode(F.filter(F.lit(on).cast("array<int>"), lambda k: (k >= c("_own")) if equal else (k > c("_own"))))
        a = _bucketed(longer, c("_own"))
        b = _bucketed(shorter, at)
        renamed = {x: f"{x}2" for x in ("_from", "_to", "_own", "_first")}
        pairs = a.join(b.withColumnsRenamed(renamed), [*keys, "_at", "_bucket"])
        return pairs.filter((c("_from") < c("_to2")) & (c("_from2") < c("_to")) & (c("_bucket") == F.greatest("_first", "_first2"))).withColumns({"overlap_from": F.greatest("_from", "_from2"), "overlap_to": F.least("_to", "_to2")})

    names = [*keys, *(x for x in left.columns if x not in keys), *(x for x in right.columns if x not in keys), "overlap_from", "overlap_to"]
    if not levels[0] or not levels[1]:
        found = left.join(right, keys).limit(0).withColumns({"overlap_from": F.lit(0).cast("long"), "overlap_to": F.lit(0).cast("long")})
        return found.select(*names)
    return meet(sides[0], sides[1], levels[0], True).select(*names).unionByName(meet(sides[1], sides[0], levels[1], False).select(*names))


def gaps(trades: DataFrame, seconds: int) -> DataFrame:
    """Pauses of more than ``seconds`` between a symbol's trades within a session: symbol, session_date, gap_from, gap_to (microseconds)."""
    t = trades.withColumn("us", micros(trades)).groupBy("symbol", "session_date", "us").agg(F.lit(1).alias("one"))
    before = F.lag("us").over(Window.partitionBy("symbol", "session_date").orderBy("us"))
    return t.select("symbol", "session_date", before.alias("gap_from"), F.col("us").alias("gap_to")).filter(F.col("gap_to") - F.col("gap_from") > seconds * 1_000_000)


def wave_times(trades: DataFrame, interval: int, rules: WaveRules = RULES) -> DataFrame:
    """Waves with the times of their first and last trade; an open wave lasts to its candle's last trade."""
    t = indexed(trades, interval)
    found = all_waves(t, interval, rules).select(*CANDLE, "wave", "side", "start_idx", F.coalesce("end_idx", "last_idx").alias("to_idx"))
    at = t.select(*CANDLE, "idx", "us")
    ends = found.select(*CANDLE, "wave", F.explode(F.array("start_idx", "to_idx")).alias("idx")).distinct().join(at, [*CANDLE, "idx"])
    times = ends.groupBy(*CANDLE, "wave").agg(F.min("us").alias("wave_from"), F.max("us").alias("wave_to"))
    return found.join(times, [*CANDLE, "wave"]).select(*CANDLE, "wave", "side", "wave_from", "wave_to")


def wave_gap_overlap(trades: DataFrame, interval: int, seconds: int, rules: WaveRules = RULES) -> DataFrame:
    """The pauses that fall into each wave, with the part of them that does."""
    found = overlap_join(wave_times(trades, interval, rules), gaps(trades, seconds), ["symbol"], ("wave_from", "wave_to"), ("gap_from", "gap_to"))
    return found.withColumn("overlap_us", F.col("overlap_to") - F.col("overlap_from"))
