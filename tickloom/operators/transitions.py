"""Transitions between consecutive candles' families, motifs of three, and stability over sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import when_chain
from .quality import SESSION
from .research import with_session


def _next(rows: DataFrame, interval: int) -> DataFrame:
    """``next`` and ``next2``: the families of the following candles, null beyond a gap or the session's end."""
    w = Window.partitionBy(*SESSION).orderBy("start")
    out = with_session(rows)
    for k, name in ((1, "next"), (2, "next2")):
        near = F.lead("start", k).over(w) == F.col("start") + k * interval
        out = out.withColumn(name, F.when(near, F.lead("family", k).over(w)))
    return out.withColumn("next2", F.when(F.col("next").isNotNull(), F.col("next2")))


def transitions(families: DataFrame, interval: int) -> DataFrame:
    g = _next(families, interval).filter("next IS NOT NULL").groupBy("symbol", F.col("family").alias("from_family"), F.col("next").alias("to_family")).agg(F.count("*").alias("count"))
    return g.withColumn("probability", F.col("count") / F.sum("count").over(Window.partitionBy("symbol", "from_family")))


def motifs(families: DataFrame, interval: int, limit: int = 12) -> DataFrame:
    """The most frequent runs of three, by symbol; of equal ones the first to occur."""
    g = _next(families, interval).filter("next2 IS NOT NULL").groupBy("symbol", F.col("family").alias("first"), F.col("next").alias("second"), F.col("next2").alias("third")).agg(F.count("*").alias("count"), F.min("start").alias("first_start"))
    w = Window.partitionBy("symbol").orderBy(F.desc("count"), "first_start", "first", "second", "third")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def neighbours(families: DataFrame, interval: int) -> DataFrame:
    """Each candle with the one before and after it, null unless contiguous on the same day."""
    w = Window.partitionBy(*SESSION).orderBy("start")
    near = lambda f, d: F.when(f("start").over(w) == F.col("start") + d * interval, f("family").over(w))
    return with_session(families).withColumns({"previous": near(F.lag, -1), "next": near(F.lead, 1)})


def daypart(start: Column) -> Column:
    hour = F.floor(start % 86_400 / 3600)
    return F.when(hour < 11, "MANHA_INICIAL").when(hour < 14, "MEIO_DO_DIA").when(hour < 17, "TARDE").otherwise("FECHAMENTO")


def _entropy(rows: DataFrame, keys: list[str], c: str) -> DataFrame:
    """H / ln(kinds) of ``c`` by ``keys``; 0 for one kind."""
    g = rows.filter(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    g = g.withColumn("h", -p * F.log(p)).groupBy(*keys).agg(F.sum("h").alias("h"), F.count("*").alias("kinds"))
    return g.select(*keys, F.when(F.col("kinds") > 1, F.col("h") / F.log(F.col("kinds").cast("double"))).otherwise(0.0).alias(f"entropy_{c}"))


def stability(families: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """How evenly each family is spread over sessions and contexts, by symbol. ``features``: candles with
    volatility_bucket and regime_medium. Sessions without the family count with share 0."""
    c = F.col
    rows = with_session(families).withColumn("daypart", daypart(c("start")))
    contexts = ["volatility_bucket", "regime_medium"]
    if features is not None:
        rows = rows.join(features.select("symbol", "start", *contexts), ["symbol", "start"], "left")
    else:
        rows = rows.withColumns({x: F.lit(None).cast("string") for x in contexts})
    by_session = rows.groupBy(*SESSION, "family").agg(F.count("*").alias("n"))
    totals = by_session.groupBy(*SESSION).agg(F.sum("n").alias("all"))
    of_symbol = totals.groupBy("symbol").agg(F.count("*").alias("sessions_all"), F.sum("all").alias("candles"))
    shares = by_session.join(totals, SESSION).withColumn("share", c("n") / c("all"))
    g = shares.groupBy("symbol", "family").agg(F.sum("n").alias("count"), F.count("*").alias("sessions"), F.sum("share").alias("s1"), F.sum(c("share") * c("share")).alias("s2")).join(of_symbol, "symbol")
    mean = c("s1") / c("sessions_all")
    g = g.withColumn("mean_session_share", mean).withColumn("session_share_std", F.sqrt(F.greatest(F.lit(0.0), c("s2") / c("sessions_all") - c("mean_session_share") * c("mean_session_share"))))
    keys = ["symbol", "family"]
    for x in ("daypart", *contexts):
        g = g.join(_entropy(rows, keys, x), keys, "left")
    spread = sum((F.coalesce(f"entropy_{x}", F.lit(0.0)) for x in ("daypart", *contexts)), F.lit(0.0)) / 3
    g = g.withColumns(
        {
            "prevalence": c("sessions") / c("sessions_all"),
            "consistency": F.greatest(F.lit(0.0), 1 - F.least(c("session_share_std") / F.greatest(c("mean_session_share"), F.lit(0.05)), F.lit(1.0))),
            "context_spread": spread,
        }
    )
    g = g.withColumn("score", F.round(F.round(100 * (0.45 * c("prevalence") + 0.35 * c("consistency") + 0.20 * c("context_spread")), 6), 1))
    label = when_chain((c("count") < 5, "AMOSTRA_PEQUENA"), (c("score") >= 70, "DISTRIBUIDA"), (c("score") >= 45, "MODERADA"), default="CONCENTRADA")
    return g.select(*keys, "count", (c("count") / c("candles")).alias("share"), "sessions", "prevalence", "mean_session_share", "session_share_std", "consistency", "context_spread", "score", label.alias("label"))


def distributions(families: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Counts of each family by hour, part of the day and month, and by volatility, medium regime and the session's regime where
    ``features`` (a research index) has the candle; in long form."""
    rows = with_session(families)
    contexts = {"volatility": "volatility_bucket", "context_regime": "regime_medium", "session_regime": "session_regime"}
    if features is not None:
        rows = rows.join(features.select("symbol", "start", *contexts.values()), ["symbol", "start"], "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in contexts.values()})
    of = lambda kind, value: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    kinds = F.array_compact(
        F.array(
            of("hour", F.format_string("%02dh", F.floor(F.col("start") % 86_400 / 3600))),
            of("daypart", daypart(F.col("start"))),
            of("month", F.date_format("session_date", "yyyy-MM")),
            *[of(kind, F.col(c)) for kind, c in contexts.items()],
        )
    )
    return rows.select("symbol", "family", F.explode(kinds).alias("x")).groupBy("symbol", "family", "x.kind", "x.value").agg(F.count("*").alias("count"))
