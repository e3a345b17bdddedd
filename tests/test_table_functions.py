"""Table functions called from SQL."""

import pytest

from tests.helpers import trades
from tickloom.functions import tables
from tickloom.operators.waves import WaveRules, all_waves, pressure_window

COLUMNS = "symbol start wave side start_idx peak_idx peak_qty peak_dominance end_idx termination last_idx".split()


def test_waves_from_sql_equal_the_operator(spark):
    tables.register(spark)
    t = trades(spark, [(k, 100 + k % 5, 1 + k % 7, "BUY" if k % 80 < 45 else "NONE", "A") for k in range(240)])
    pressure_window(t, 60, 5).createOrReplaceTempView("pressure")
    got = spark.sql("SELECT * FROM waves_of(TABLE(pressure) PARTITION BY (symbol, start) ORDER BY idx, window_trades => 5)")
    assert got.columns == COLUMNS
    want = all_waves(t, 60, WaveRules(window=5)).select(*COLUMNS)
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, want.collect())) and rows
    # and in a join, as any table
    assert spark.sql("SELECT w.side, count(*) AS n FROM waves_of(TABLE(pressure) PARTITION BY (symbol, start) ORDER BY idx, window_trades => 5) w JOIN pressure p ON p.symbol = w.symbol AND p.start = w.start AND p.idx = w.start_idx GROUP BY w.side").count() == 1


def test_calls_are_checked(spark):
    tables.register(spark)
    spark.range(3).createOrReplaceTempView("other")
    with pytest.raises(Exception, match="has no symbol"):
        spark.sql("SELECT * FROM waves_of(TABLE(other) PARTITION BY id)").collect()
