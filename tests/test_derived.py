"""Derived tables that follow the trades."""

from datetime import timedelta

from pyspark.sql import functions as F

from tests.helpers import T0, trades
from tickloom.operators.quality import Schedule
from tickloom.sources import derived
from tickloom.sources.store import Store

DAYS = 6
TABLE = derived.index_table([Schedule("ALL", "", 0, 86_400)])


def session(spark, k, prices, symbol="WINTEST", shift=0):
    return trades(spark, [(shift + 60 * n, p, 1 + n % 3, "BUY" if n % 2 else "SELL", "A") for n, p in enumerate(prices)], T0 + timedelta(days=k), symbol)


def library(spark, days=range(DAYS), symbol="WINTEST"):
    out = None
    for k in days:
        one = session(spark, k, [100 + k, 103 + 2 * k, 99 + k, 101 + 3 * k], symbol)
        out = one if out is None else out.unionAll(one)
    return out


def rows(df):
    names = sorted(c for c in df.columns if c != "interval_seconds")
    return sorted(str([r[c] for c in names]) for r in df.collect())


def full(store, table=TABLE, interval=300):
    return rows(table.build(store.read("trades"), interval))


def test_only_what_moved_is_rebuilt(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.add_trades(library(spark).unionAll(library(spark, symbol="OTHER")))
    assert derived.refresh(store, TABLE, 300) == {"sessions": 12, "rebuilt": 12, "read": 12, "removed": 0}
    assert rows(derived.read(store, TABLE, 300)) == full(store)
    assert derived.refresh(store, TABLE, 300) == {"sessions": 12, "rebuilt": 0, "read": 0, "removed": 0}
    before = {r[0]: r[1] for r in derived.read(store, TABLE, 300).select("_metadata.file_path", "_metadata.file_modification_time").distinct().collect()}
    # a late trade of day 2: its session, and the next one's opening gap
    store.add_trades(session(spark, 2, [180], shift=400))
    assert derived.refresh(store, TABLE, 300) == {"sessions": 12, "rebuilt": 2, "read": 3, "removed": 0}
    assert rows(derived.read(store, TABLE, 300)) == full(store)
    after = {r[0]: r[1] for r in derived.read(store, TABLE, 300).select("_metadata.file_path", "_metadata.file_modification_time").distinct().collect()}
    assert len(before.keys() & after.keys()) == 10 and all("symbol=WINTEST" in x for x in after.keys() - before.keys())
    # another interval is a table of its own
    assert derived.refresh(store, TABLE, 3600)["rebuilt"] == 12 and derived.refresh(store, TABLE, 300)["rebuilt"] == 0


def test_new_and_vanished_sessions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.add_trades(library(spark, [0, 1, 3, 4]))
    derived.refresh(store, TABLE, 300)
    # a session between two others: it and the next one
    store.add_trades(library(spark, [2]))
    assert derived.refresh(store, TABLE, 300) == {"sessions": 5, "rebuilt": 2, "read": 3, "removed": 0}
    assert rows(derived.read(store, TABLE, 300)) == full(store)
    store._remove_partition("trades", symbol="WINTEST", session_date=T0.date() + timedelta(days=1))
    assert derived.refresh(store, TABLE, 300) == {"sessions": 4, "rebuilt": 1, "read": 2, "removed": 1}
    assert rows(derived.ensure(store, TABLE, 300)) == full(store)
    store._remove_partition("trades", symbol="WINTEST")
    assert derived.refresh(store, TABLE, 300)["removed"] == 4
    assert derived.refresh(store, TABLE, 300) == {"sessions": 0, "rebuilt": 0, "read": 0, "removed": 0}


def test_enrichment_moves_the_fingerprint_and_a_new_version_rebuilds_all(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    poor = library(spark).withColumns({"source_row": F.monotonically_increasing_id(), "aggressor": F.lit("NONE")})
    store.add_slice(poor, "f")
    derived.refresh(store, TABLE, 300)
    rich = poor.filter(F.col("session_date") == F.lit(T0.date())).withColumn("aggressor", F.lit("BUY"))
    assert store.add_slice(rich, "f")["enriched"] == 4
    assert derived.refresh(store, TABLE, 300)["rebuilt"] == 2
    assert rows(derived.read(store, TABLE, 300)) == full(store)
    assert derived.refresh(store, derived.Derived(TABLE.name, TABLE.build, TABLE.before, "2"), 300)["rebuilt"] == DAYS


def test_a_refresh_that_broke_off_is_done_again(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.add_trades(library(spark))
    write = derived._write

    def broken(rows, path, keys):
        if path.endswith("built_from"):
            raise OSError("lost")
        write(rows, path, keys)

    monkeypatch.setattr(derived, "_write", broken)
    try:
        derived.refresh(store, TABLE, 300)
    except OSError:
        pass
    monkeypatch.setattr(derived, "_write", write)
    assert derived.refresh(store, TABLE, 300)["rebuilt"] == DAYS
    assert rows(derived.read(store, TABLE, 300)) == full(store)


def test_scan_names_the_touched_partitions_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.add_trades(library(spark))
    two = store.read("trades").select(*derived.SESSION).distinct().orderBy("session_date").limit(2)
    scan = store.partitions_of("trades", two)
    assert scan.select("_metadata.file_path").distinct().count() == 2
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "session_date" in plan.partition("PartitionFilters")[2].partition("PushedFilters")[0]


def test_candles_and_quality_look_at_their_own_session_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.add_trades(library(spark))
    for table in (derived.candle_table(), derived.quality_table([Schedule("ALL", "", 0, 86_400)])):
        derived.refresh(store, table, 300)
    store.add_trades(session(spark, 3, [150], shift=900))
    for table in (derived.candle_table(), derived.quality_table([Schedule("ALL", "", 0, 86_400)])):
        assert derived.refresh(store, table, 300) == {"sessions": DAYS, "rebuilt": 1, "read": 1, "removed": 0}
        assert rows(derived.read(store, table, 300)) == full(store, table)
