"""Bulk loads by blocks, and CSV quoting."""

import csv
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import one, trades
from tickloom.sources import bulk_load, csv_trades, store


def lines(path, n, descending=False, tail=()):
    at = [datetime(2026, 10, 7, 10) + timedelta(seconds=k) for k in range(n)]
    rows = [f"WINX26,{t:%d/%m/%y},{t:%H:%M:%S},A,{1000 + 5 * (k % 7)},1,B,{'Comprador' if k % 3 else 'RLP'}" for k, t in enumerate(at)]
    path.write_text("\n".join([*(rows[::-1] if descending else rows), *tail]) + "\n")
    return str(path)


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "540b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_load_goes_on_at_its_first_unfinished_block(spark, tmp_path, small_blocks, monkeypatch):
    path, s = lines(tmp_path / "a.csv", 60, descending=True), store.Store(spark, str(tmp_path / "db"))
    calls, add = [], store.Store.add_slice

    def counted(self, rows, mark):
        calls.append("step")
        if len(calls) == 3:
            raise OSError("killed")
        return add(self, rows, mark)

    monkeypatch.setattr(store.Store, "add_slice", counted)
    with pytest.raises(OSError, match="killed"):
        s.load_file(path, tick_size=5, step_rows=1)
    seen = one(bulk_load.progress(s))
    assert (seen.state, seen.steps, seen.steps_done, seen.rows) == ("FAILED", 5, 2, 60) and seen.share == 0.4 and 0 < seen.received < 60
    read = []
    monkeypatch.setattr(bulk_load, "stage", lambda *a, **k: read.append(a))
    done = s.load_file(path, tick_size=5, step_rows=1)
    assert len(calls) == 6 and not read  # three steps, and the file itself isn't read again
    assert done["inserted"] == 60 - seen.received and s.read("trades").count() == 60
    seen = one(bulk_load.progress(s))
    assert (seen.state, seen.steps_done, seen.received, seen.inserted) == ("COMPLETED", 5, 60, 60) and seen.rows_per_second > 0
    assert not (tmp_path / "db" / "_loads").exists() or not list((tmp_path / "db" / "_loads").iterdir())
    whole = csv_trades.trades_or_error(csv_trades.read_trades(spark, path, tick_size=5, strict=True))
    names = ["ts", "price_ticks", "sequence_no", "source_row", "flags"]
    assert sorted(map(str, s.read("trades").select(names).collect())) == sorted(map(str, whole.select(names).collect()))


def test_steps_equal_one_step(spark, tmp_path, small_blocks):
    path = lines(tmp_path / "a.csv", 40)
    tables = []
    for rows in (1, 10**9):
        s = store.Store(spark, str(tmp_path / f"db{rows}"))
        assert s.load_file(path, tick_size=5, step_rows=rows)["inserted"] == 40
        tables.append(sorted(map(str, s.read("trades").collect())))
        assert s.load_file(path, tick_size=5)["state"] == "SKIPPED"
    assert tables[0] == tables[1]


def test_a_bad_line_is_named_by_its_number_in_the_file(spark, tmp_path, small_blocks):
    path = lines(tmp_path / "a.csv", 30, tail=["WINX26,07/10/26,10:30:00,A,1003,1,B,Comprador"])
    s = store.Store(spark, str(tmp_path / "db"))
    with pytest.raises(Exception, match="line 31"):
        s.load_file(path, tick_size=5, step_rows=10)
    assert [r.state for r in s.latest_batches(2).collect()] == ["FAILED", "RUNNING"]
    fixed = lines(tmp_path / "b.csv", 31)
    assert s.load_file(fixed, tick_size=5)["state"] == "COMPLETED"


def test_line_numbers_over_blocks(spark, tmp_path, small_blocks):
    path = tmp_path / "n.txt"
    path.write_text("".join(f"{k}{'x' * (k % 50)}\n" for k in range(1, 300)))
    got = csv_trades._lines(spark, str(path)).collect()
    assert len(got) == 299 and all(int(r.value.rstrip("x")) == r.source_row for r in got)


def test_a_line_is_parsed_once(spark, tmp_path):
    t = csv_trades.read_trades(spark, lines(tmp_path / "a.csv", 20), tick_size=5)
    for of in (t.filter("ts IS NOT NULL").select("source_row", "ts"), csv_trades.trades_or_error(t)):
        plan = of._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_csv") == 1 and plan.count("rightHint=(strategy=broadcast)") == 1
        assert of.count() == 20


def test_quotes_by_the_rules_of_csv(spark, tmp_path):
    agents = ['XP "CCTVM" SA', 'XP"', "a;b", 'x";"y', "back\\", 'back\\"slash', '"', "plain"]
    path = tmp_path / "q.csv"
    with path.open("w", newline="") as f:
        w = csv.writer(f, delimiter=";")
        w.writerow("Ativo Data Hora Preço Qtd Comprador".split())
        w.writerows(["WINX26", "07/10/2026", f"10:00:{k:02d}", "1005", "1", a] for k, a in enumerate(agents))
    got = csv_trades.read_trades(spark, str(path), tick_size=5, strict=True).orderBy("source_row").collect()
    assert [r.buyer_id for r in got] == agents and {r.problem for r in got} == {None}
    cells = csv_trades.numbered(spark, str(path), csv_trades.probe(spark, str(path))).select("_n_cells").distinct().collect()
    assert [r[0] for r in cells] == [6]
    # a quote inside a cell that doesn't start with one is a character
    path.write_text('Ativo;Data;Hora;Preço;Qtd;Comprador\nWINX26;07/10/2026;10:00:00;1005;1;a"b\nWINX26;07/10/2026;10:00:01;1005;1;c"d\n')
    assert [r.buyer_id for r in csv_trades.read_trades(spark, str(path), tick_size=5).orderBy("source_row").collect()] == ['a"b', 'c"d']


def test_exports_quote_as_csv_readers_do(spark, tmp_path):
    agent = 'XP "A", b\\'
    store.export_csv(trades(spark, [(0, 100, 1, "BUY", agent)]), str(tmp_path / "out"), 1)
    [text] = [p.read_text() for p in (tmp_path / "out").glob("part-*")]
    assert next(csv.reader([text.rstrip("\n")]))[3] == agent


def test_rules_of_slices_and_probes(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    t = trades(spark, [(k, 100, 1, "BUY", "A") for k in range(10)])
    s.add_trades(t)
    t0 = datetime(2026, 10, 7, 10)
    assert s.load_slice(" wintest", t0, t0 + timedelta(hours=3)).count() == 10
    for symbol, start, end in (("WINTEST", t0, t0 + timedelta(hours=3, seconds=1)), ("WINTEST", t0, t0), (" ", t0, t0 + timedelta(minutes=1))):
        with pytest.raises(ValueError):
            s.load_slice(symbol, start, end)
    p = one(csv_trades.source_probe(t, order="sequence_no", least_times=csv_trades.LEAST_TIMES))
    assert (p.rows, p.times, p.problem) == (10, 10, None)
    few = t.filter("sequence_no <= 2")
    assert one(csv_trades.source_probe(few, order="sequence_no", least_times=csv_trades.LEAST_TIMES)).problem == "too few distinct times"


def test_writes_count_themselves(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    t = trades(spark, [(k, 100, 1, "BUY", "A") for k in range(6)])
    assert s.add_trades(t.limit(0)) == {"received": 0, "inserted": 0, "duplicates": 0}
    assert s.add_trades(t.filter("sequence_no <= 4")) == {"received": 4, "inserted": 4, "duplicates": 0}
    assert s.add_trades(t) == {"received": 6, "inserted": 2, "duplicates": 4}
    assert s.add_trades(t) == {"received": 6, "inserted": 0, "duplicates": 6}
    assert s.add_slice(t.withColumn("source_row", F.col("sequence_no")), "f") == {"received": 6, "inserted": 6, "duplicates": 0, "enriched": 0}


def test_rows_that_are_new_are_not_shuffled(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    t = trades(spark, [(k, 100, 1, "BUY", "A") for k in range(8)]).withColumn("event_key", F.col("trade_id"))
    old, rows = t.filter("sequence_no <= 3"), t.filter("sequence_no > 3")
    for held in (None, old):
        fresh, _ = s._fresh(held, rows, "event_key")
        plan = fresh._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and fresh.count() == 5
    mixed = t.filter("sequence_no >= 2").unionByName(t.filter("sequence_no >= 7"))
    for held, want in ((None, "2345678"), (old, "45678")):
        fresh, _ = s._fresh(held, mixed, "event_key")
        assert sorted(r.event_key for r in fresh.collect()) == list(want)
