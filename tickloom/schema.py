"""The trade table and its canonical order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

TRADES = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("session_date", T.DateType()),
        T.StructField("price_ticks", T.LongType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("trade_id", T.StringType()),
        T.StructField("aggressor", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("buyer_id", T.StringType()),
        T.StructField("seller_id", T.StringType()),
        T.StructField("sequence_no", T.LongType()),
        T.StructField("flags", T.StringType()),
    ]
)
REFERENCES = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("start", T.LongType()), T.StructField("interval_seconds", T.IntegerType())]
    + [T.StructField(c, T.LongType()) for c in ("open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "trades")]
    + [T.StructField("source", T.StringType())]
)

#: The largest long stands for a missing sequence number: such trades come last.
LAST = (1 << 63) - 1
CANDLE = ["symbol", "start"]


def micros(df: DataFrame, c: str = "ts") -> Column:
    """Microseconds since the epoch; wall-clock timestamps don't depend on the session's time zone."""
    if isinstance(df.schema[c].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")
    return F.unix_micros(c)


def with_start(trades: DataFrame, interval: int) -> DataFrame:
    """Adds ``us`` and the candle's ``start`` (epoch seconds, aligned to the epoch). Trades that are ``indexed`` keep theirs."""
    if interval <= 0:
        raise ValueError("interval must be positive")
    if "idx" in trades.columns:
        return trades
    us = trades if "us" in trades.columns else trades.withColumn("us", micros(trades))
    return us.withColumn("start", (F.floor(F.floor(F.col("us") / 1_000_000) / interval) * interval).cast("long"))


def order() -> list[Column]:
    """Time, file order (missing last), numeric trade ids before texts."""
    number = F.expr("try_cast(trade_id AS BIGINT)")
    return [F.col("us"), F.coalesce("sequence_no", F.lit(LAST)), number.isNull().cast("int"), F.coalesce(number, F.lit(0)), F.coalesce("trade_id", F.lit(""))]


def order_key(trades: DataFrame | None = None) -> Column:
    """A key for ordered aggregates; of indexed trades their place, which needs no sort."""
    if trades is not None and "idx" in trades.columns:
        return F.col("idx")
    return F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order())])


def indexed(trades: DataFrame, interval: int) -> DataFrame:
    """Trades with their candle's ``start`` and their place ``idx`` in it. Later windows partition by
    the same keys and order by ``idx``, so they share its one shuffle. Indexed trades are given back as they are: what
    several operators take is indexed and written once (``indexed_once``), and then needs no shuffle or sort again."""
    if "idx" in trades.columns:
        return trades
    w = Window.partitionBy(*CANDLE).orderBy(*order())
    return with_start(trades, interval).withColumn("idx", F.row_number().over(w) - 1)


def indexed_once(trades: DataFrame, interval: int) -> DataFrame:
    """Indexed trades, written to the shared folder: for results that several aggregates of the same candles go into. ``idx`` is their order, so what made it,
    and what tells trades apart in the store, isn't written."""
    from .sources.scratch import cut

    return trades if "idx" in trades.columns else cut(indexed(trades, interval).drop("trade_id", "sequence_no", "event_key", "source_row"))


def in_candle() -> Window:
    return Window.partitionBy(*CANDLE).orderBy("idx")


def whole_candle() -> Window:
    return Window.partitionBy(*CANDLE)


def is_rlp() -> Column:
    return (F.col("aggressor") == "NONE") & F.coalesce(F.col("flags").contains("raw_aggressor=RLP"), F.lit(False))


def when_chain(*cases: tuple[Column, object], default: object = None) -> Column:
    out = F.when(*_case(cases[0]))
    for case in cases[1:]:
        out = out.when(*_case(case))
    return out if default is None else out.otherwise(default)


def _case(case):
    condition, value = case
    return condition, value if isinstance(value, Column) else F.lit(value)


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, or the default where b is 0."""
    out = F.when(b != 0, a / b)
    return out if default is None else out.otherwise(default)
