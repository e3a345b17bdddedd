"""Derived tables that follow the trades: candles, session quality and the research index, rebuilt only where trades changed.

Each (symbol, day) partition of trades has a fingerprint, made of its files' names, sizes and times: a listing, no data is read. Beside a derived table
stand the fingerprints that its partitions were built from. A refresh rebuilds the sessions whose fingerprint moved and, where
results look back at earlier sessions, the sessions after them, reads no other partition of trades, and overwrites no other partition of the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..operators.candles import build_candles
from ..operators.quality import SCHEDULES, Schedule, session_quality
from ..operators.research import research_index, with_session
from .store import Store

SESSION = ["symbol", "session_date"]
KEYS = ["interval_seconds", *SESSION]
FILES = "path string, modificationTime timestamp, length bigint, content binary, symbol string, session_date date"
STATE = "symbol string, session_date date, fingerprint string, interval_seconds int"


@dataclass(frozen=True)
class Derived:
    """``build`` takes trades and an interval and gives rows with symbol and session_date. Its rows of a session depend on that session's
    trades and on those of ``before`` sessions of the symbol before it. ``version`` changes with the definition."""

    name: str
    build: Callable[[DataFrame, int], DataFrame]
    before: int = 0
    version: str = "1"


def candle_table(name: str = "candles") -> Derived:
    return Derived(name, lambda t, interval: with_session(build_candles(t, interval)))


def quality_table(schedules: list[Schedule] = SCHEDULES, name: str = "quality") -> Derived:
    return Derived(name, lambda t, interval: session_quality(t, schedules))


def index_table(schedules: list[Schedule] = SCHEDULES, name: str = "research") -> Derived:
    """The opening gap is measured against the session before."""
    return Derived(name, lambda t, interval: research_index(t, interval, schedules), before=1)


def fingerprints(store: Store, version: str = "") -> DataFrame:
    """Rows (symbol, session_date, fingerprint) of the stored trades, from a listing of their files."""
    spark = store.spark
    fs, parts = store._files(f"{store._path('trades')}/symbol=*/session_date=*")
    if not fs.globStatus(parts):
        return spark.createDataFrame([], STATE).drop("interval_seconds")
    files = spark.read.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.parquet").load(store._path("trades"))
    marks = [F.sum(F.xxhash64(F.lit(k), "path", "length", "modificationTime").cast("decimal(38,0)")).cast("string") for k in range(2)]
    return files.groupBy(*SESSION).agg(F.concat_ws(":", F.lit(version), F.count("*").cast("string"), *marks).alias("fingerprint"))


def _path(store: Store, table: Derived, part: str) -> str:
    return f"{store.root}/derived/{table.name}/{part}"


def built_from(store: Store, table: Derived, interval: int) -> DataFrame:
    """The fingerprints that the table's sessions were built from."""
    path = _path(store, table, "built_from")
    if not store._exists(path):
        return store.spark.createDataFrame([], STATE).drop("interval_seconds")
    return store.spark.read.schema(STATE).parquet(path).filter(F.col("interval_seconds") == interval).drop("interval_seconds")


def stale(now: DataFrame, then: DataFrame, before: int) -> DataFrame:
    """All sessions that are or were, with ``rebuild`` (its trades moved, or those of one of the ``before`` sessions before it), ``read`` (a rebuild needs its
    trades) and ``gone`` (it has no trades any more). One row a session."""
    c = F.col
    s = now.withColumnRenamed("fingerprint", "now").join(then.withColumnRenamed("fingerprint", "then"), SESSION, "full_outer")
    s = s.withColumns({"gone": c("now").isNull(), "moved": ~c("now").eqNullSafe(c("then"))})
    # a session that is gone changes which session comes before the next ones
    w = Window.partitionBy("symbol").orderBy("session_date")
    s = s.withColumn("rebuild", c("moved") if not before else F.max("moved").over(w.rowsBetween(-before, 0)))
    if before:
        # of those that are left, the last ``before`` ones before a rebuilt one are read with it
        left = F.sum(F.when(c("gone"), 0).otherwise(1)).over(w)
        s = s.withColumn("place", left)
        near = w.orderBy("place").rangeBetween(0, before)
        s = s.withColumn("read", F.max(c("rebuild") & ~c("gone")).over(near) & ~c("gone"))
    else:
        s = s.withColumn("read", c("rebuild") & ~c("gone"))
    return s.select(*SESSION, (c("rebuild") & ~c("gone")).alias("rebuild"), "read", "gone", "now")


def refresh(store: Store, table: Derived, interval: int) -> dict[str, int]:
    """Brings the table up to date: the number of ``sessions``, and of those ``rebuilt``, ``read`` and ``removed``. The rows are written before
    their fingerprints, so a refresh that was broken off is done again."""
    if interval <= 0 or 86_400 % interval:
        raise ValueError("a derived table's candles must divide the day")
    spark, c = store.spark, F.col
    then = built_from(store, table, interval)
    found, path = store._staged(stale(fingerprints(store, table.version), then, table.before))
    n = found.agg(F.count_if(~c("gone")), F.count_if("rebuild"), F.count_if("read"), F.count_if("gone")).first()
    sessions, rebuilt, read, removed = n
    if rebuilt:
        trades = store.partitions_of("trades", found.filter("read"))
        rows = table.build(trades, interval).join(found.filter("rebuild").select(*SESSION), SESSION, "left_semi")
        _write(rows.withColumn("interval_seconds", F.lit(interval)), _path(store, table, "rows"), KEYS)
    for r in found.filter("gone").select(*SESSION).toLocalIterator():
        _remove(store, table, interval, r)
    if rebuilt or removed:
        _write(found.filter("NOT gone").select(*SESSION, c("now").alias("fingerprint"), F.lit(interval).alias("interval_seconds")), _path(store, table, "built_from"), ["interval_seconds"])
        if not sessions:
            fs, p = store._files(f"{_path(store, table, 'built_from')}/interval_seconds={interval}")
            fs.delete(p, True)
    store._drop_staged(path)
    return {"sessions": sessions, "rebuilt": rebuilt, "read": read, "removed": removed}


def _write(rows: DataFrame, path: str, keys: list[str]) -> None:
    rows.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(path)


def _remove(store: Store, table: Derived, interval: int, session) -> None:
    escape = store.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    fs, p = store._files(f"{_path(store, table, 'rows')}/interval_seconds={interval}/symbol={escape(session['symbol'])}/session_date={session['session_date']}")
    fs.delete(p, True)


def read(store: Store, table: Derived, interval: int) -> DataFrame | None:
    """The table as it was built last."""
    path = _path(store, table, "rows")
    if not store._exists(path):
        return None
    types = {"interval_seconds": T.IntegerType(), "symbol": T.StringType(), "session_date": T.DateType()}
    found = store.spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(f.name, types.get(f.name, f.dataType)) for f in found])
    return store.spark.read.schema(schema).parquet(path).filter(F.col("interval_seconds") == interval)


def ensure(store: Store, table: Derived, interval: int) -> DataFrame | None:
    """The table, refreshed first if trades changed since."""
    refresh(store, table, interval)
    return read(store, table, interval)
