"""Session quality: coverage of the schedule, gaps, score, status, eligibility."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import when_chain, with_start

SESSION = ["symbol", "session_date"]


@dataclass(frozen=True)
class Schedule:
    schedule_id: str
    prefix: str
    open_seconds: int
    close_seconds: int
    effective_from: date | None = None
    effective_to: date | None = None
    exact: bool = False


#: The trading hours of known contracts, the more specific first.
SCHEDULES = [
    Schedule("SYNTHETIC_WINLAB06_V1", "WINLAB06", 36_000, 36_720, date(2026, 10, 1), exact=True),
    Schedule("B3_WIN_2025_03_10", "WIN", 32_400, 66_300, date(2025, 3, 10)),
    Schedule("B3_WDO_2025_03_10", "WDO", 32_400, 66_600, date(2025, 3, 10)),
]


def schedule_columns(schedules: list[Schedule]) -> dict[str, Column]:
    """The schedule of a row's symbol and date. The first schedule whose symbol fits is the only candidate."""
    symbol = F.upper(F.trim("symbol"))
    names, opens, closes = [], [], []
    for s in schedules:
        fits = symbol == s.prefix if s.exact else symbol.startswith(s.prefix)
        ok = F.lit(True)
        if s.effective_from:
            ok = ok & (F.col("session_date") >= F.lit(s.effective_from))
        if s.effective_to:
            ok = ok & (F.col("session_date") <= F.lit(s.effective_to))
        for values, v in ((names, F.lit(s.schedule_id)), (opens, F.lit(s.open_seconds)), (closes, F.lit(s.close_seconds))):
            values.append((fits, F.when(ok, v)))
    return {"schedule_id": when_chain(*names), "open_s": when_chain(*opens), "close_s": when_chain(*closes)}


def _gaps(trades: DataFrame) -> DataFrame:
    w = Window.partitionBy(*SESSION).orderBy("us")  # between trades of one time the gap is 0 in any order
    t = with_start(trades, 60).withColumn("before_us", F.lag("us").over(w)).withColumn("gap", (F.col("us") - F.col("before_us")) / 1e6)
    p95 = F.coalesce(F.percentile("gap", 0.95).over(Window.partitionBy(*SESSION)), F.lit(0.0))
    return t.withColumn("p95", p95).withColumn("threshold", F.greatest(F.lit(60.0), F.least(F.lit(300.0), F.greatest(F.lit(1.0), F.col("p95")) * 20.0)))


def boundary_score(delay: Column) -> Column:
    return F.when(delay.isNull(), 0.0).when(delay <= 120, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (delay - 120) / 780.0))


def session_quality(trades: DataFrame, schedules: list[Schedule] = SCHEDULES) -> DataFrame:
    c = F.col
    day_us = F.datediff("session_date", F.lit("1970-01-01").cast("date")).cast("long") * F.lit(86_400_000_000)
    t = _gaps(trades).withColumns(schedule_columns(schedules))
    t = t.withColumns({"open_us": day_us + c("open_s").cast("long") * 1_000_000, "close_us": day_us + c("close_s").cast("long") * 1_000_000})
    minute = F.when((c("us") >= c("open_us")) & (c("us") < c("close_us")), F.floor((c("us") - c("open_us")) / 60_000_000))
    over = c("gap") > c("threshold")
    g = t.groupBy(*SESSION).agg(
        F.first("schedule_id").alias("schedule_id"),
        F.first("open_us").alias("open_us"),
        F.first("close_us").alias("close_us"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.count("*").alias("trades"),
        F.max("p95").alias("p95_intertrade_seconds"),
        F.max("threshold").alias("gap_threshold_seconds"),
        F.count_if(over).alias("gap_count"),
        F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_gap_seconds"),
        F.coalesce(F.sum(F.when(over, c("gap") - c("threshold"))), F.lit(0.0)).alias("excess"),
        F.count_distinct(minute).alias("minutes"),
    )
    zero = lambda x: F.greatest(F.lit(0.0), x)
    g = g.withColumns({"expected": F.greatest(F.lit(1.0), (c("close_us") - c("open_us")) / 1e6), "observed_span_seconds": (c("last_us") - c("first_us")) / 1e6})
    known = c("schedule_id").isNotNull()
    only = lambda x: F.when(known, x)
    g = g.withColumns(
        {
            "coverage_ratio": only(F.least(F.lit(1.0), zero((F.least("last_us", "close_us") - F.greatest("first_us", "open_us")) / 1e6) / c("expected"))),
            "start_delay_seconds": only(zero((c("first_us") - c("open_us")) / 1e6)),
            "end_early_seconds": only(zero((c("close_us") - c("last_us")) / 1e6)),
            "active_minute_ratio": only(F.least(F.lit(1.0), c("minutes") / F.greatest(F.lit(1), F.floor((c("expected") + 59) / 60)))),
        }
    )
    gap_score = zero(1 - c("excess") / F.greatest(c("expected") * 0.08, F.lit(1.0)))
    score = 100 * (0.35 * c("coverage_ratio") + 0.18 * boundary_score(c("start_delay_seconds")) + 0.18 * boundary_score(c("end_early_seconds")) + 0.19 * c("active_minute_ratio") + 0.10 * gap_score)
    g = g.withColumn("score", F.when(known, F.round(F.least(F.lit(100.0), zero(score)), 1)).when(c("gap_count") > 0, 40.0).otherwise(50.0))
    late, early = c("start_delay_seconds") > 300, c("end_early_seconds") > 300
    status = when_chain(
        (~known, "UNKNOWN_SCHEDULE"),
        (late & early, "PARTIAL_BOTH"),
        (late, "PARTIAL_START"),
        (early, "PARTIAL_END"),
        ((c("max_gap_seconds") > 300) | (c("active_minute_ratio") < 0.90), "GAPPED"),
        ((c("coverage_ratio") >= 0.985) & (c("active_minute_ratio") >= 0.97) & (c("score") >= 94), "COMPLETE"),
        ((c("coverage_ratio") >= 0.965) & (c("active_minute_ratio") >= 0.94) & (c("score") >= 88), "LIKELY_COMPLETE"),
        default="REVIEW",
    )
    g = g.withColumn("status", status)
    return g.withColumn("eligible", c("status").isin("COMPLETE", "LIKELY_COMPLETE") & (c("score") >= 88)).drop("expected", "excess", "minutes", "open_us", "close_us")


def session_gaps(trades: DataFrame, limit: int = 8) -> DataFrame:
    """The longest gaps over the session's threshold."""
    w = Window.partitionBy(*SESSION).orderBy(F.desc("gap"), "us")
    t = _gaps(trades).filter(F.col("gap") > F.col("threshold")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return t.select(*SESSION, "rank", F.col("before_us").alias("from_us"), F.col("us").alias("to_us"), F.col("gap").alias("seconds"))
