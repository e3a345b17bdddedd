"""Numbers, CSV layouts, the store and streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.helpers import one, trades
from tickloom.functions import normalize as N
from tickloom.operators.candles import build_candles
from tickloom.schema import REFERENCES, TRADES
from tickloom.sources import csv_trades, store
from tickloom.streaming.candles import deduplicated, ingest, streaming_candles


def test_numbers(spark):
    df = spark.createDataFrame([("205.935", "205935", "205.935"), ("5.321,5", "5321.5", "5321.5"), ("205935", "205935", "205935"), ("1,234.5", "1234.5", "1234.5"), ("x", None, None)], "raw string, profit string, generic string")
    for r in df.select("*", N.profit_number(F.col("raw")).alias("p"), N.generic_number(F.col("raw")).alias("g")).collect():
        assert (None if r.p is None else float(r.p)) == (None if r.profit is None else float(r.profit))
        assert (None if r.g is None else float(r.g)) == (None if r.generic is None else float(r.generic))


def test_times_and_sides(spark):
    df = spark.createDataFrame([("07/10/2026", "10:00:01.250"), ("07/10/26", "10:00:01"), ("2026-10-07", "10:00:01"), ("07/10/2026", "10:00"), ("07/10/2026", "10:00:01,5"), ("7/1/69", "9:05:07.000001"), ("31/02/2026", "10:00"), ("07/10/2026", "10"), (None, "10:00")], "d string, t string")
    got = [r[0] for r in df.select(N.timestamp(None, F.col("d"), F.col("t"))).collect()]
    assert got[:4] == [datetime(2026, 10, 7, 10, 0, 1, 250000), datetime(2026, 10, 7, 10, 0, 1), datetime(2026, 10, 7, 10, 0, 1), datetime(2026, 10, 7, 10, 0)]
    assert got[4:] == [datetime(2026, 10, 7, 10, 0, 1, 500000), datetime(1969, 1, 7, 9, 5, 7, 1), None, None, None]
    assert [r[0] for r in spark.createDataFrame([("2026-10-07T10:00:00.5",), ("2026-10-07 10:00:00,25",), ("x",)], "a string").select(N.timestamp(F.col("a"))).collect()] == [datetime(2026, 10, 7, 10, 0, 0, 500000), datetime(2026, 10, 7, 10, 0, 0, 250000), None]
    sides = spark.createDataFrame([(x,) for x in ("Comprador", "VENDA", "c", "RLP", "", None, "Agressão Compra")], "a string")
    assert [r[0] for r in sides.select(N.aggressor(F.col("a"))).collect()] == ["BUY", "SELL", "BUY", "NONE", "NONE", "NONE", "BUY"]
    assert N.header("Número do Negócio") == "numero do negocio"


def test_headerless_descending(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("WINX26,07/10/26,10:01:00,A,1005,1,B,Comprador\nWINX26,07/10/26,10:00:59,A,1000,1,B,RLP\nWINX26,07/10/26,10:00:00,A,995,2,B,Vendedor\nWINX26,07/10/26,10:00:00,A,995,2,B,Vendedor\n")
    t = csv_trades.trades_or_error(csv_trades.read_trades(spark, str(p), tick_size=5)).orderBy("sequence_no").collect()
    assert [r.price_ticks for r in t] == [199, 199, 200, 201] and [r.sequence_no for r in t] == [1, 2, 3, 4] and t[2].flags == "raw_aggressor=RLP"
    bad = tmp_path / "b.csv"
    bad.write_text("WINX26,07/10/26,10:01:00,A,1003,1,B,Comprador\n")
    assert one(csv_trades.read_trades(spark, str(bad), tick_size=5)).problem.startswith("price")
    with pytest.raises(Exception, match="line 1"):
        csv_trades.trades_or_error(csv_trades.read_trades(spark, str(bad), tick_size=5)).collect()


def test_header_latin1_preamble_and_trade_id(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes("Relatório\nAtivo;Data;Hora;Número do Negócio;Agente Comprador;Preço;Quantidade;Agente Vendedor;Agressão\nWINX26;07/10/2026;10:00:00;7;A;1.000;1;B;Comprador\nWINX26;07/10/2026;10:00:01;8;A;1.005;1;B;Vendedor\n".encode("cp1252"))
    t = csv_trades.read_trades(spark, str(p), tick_size=5).orderBy("source_row").collect()
    assert [(r.price_ticks, r.aggressor, r.trade_id, r.source_row) for r in t] == [(200, "BUY", "7", 3), (201, "SELL", "8", 4)]
    q = tmp_path / "n.csv"
    q.write_text("WINX26,07/10/26,10:01:00,1,A,1005,1,B,Comprador\nWINX26,07/10/26,10:01:30,2,A,1000,1,B,RLP\n")
    assert [r.trade_id for r in csv_trades.read_trades(spark, str(q), tick_size=5).orderBy("source_row").collect()] == ["1", "2"]


def test_references(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("Ativo;Data;Hora;Abertura;Máximo;Mínimo;Fechamento;Volume;Quantidade\nWINV26;07/10/2026;10:00:00;204.660;204.705;204.500;204.500;1.058.515.234,00;25.878\n")
    r = one(csv_trades.read_references(spark, str(p), tick_size=5, interval=60))
    assert (r.open_ticks, r.high_ticks, r.low_ticks, r.close_ticks, r.volume, r.trades) == (40932, 40941, 40900, 40900, 25878, None)


def test_diagnostics_and_minutes(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("".join(f"WINX26,07/10/26,10:0{3 - k // 2}:{30 - 30 * (k % 2):02d},A,1000,1,B,Comprador\n" for k in range(6)))
    t = csv_trades.read_trades(spark, str(p), tick_size=5)
    assert one(csv_trades.import_diagnostics(t)).source_order == "DESCENDING"
    rows = csv_trades.minute_index(t).orderBy("start").collect()
    assert [(r.first_row, r.last_row, r.trades, r.open_row, r.close_row) for r in rows] == [(5, 6, 2, 6, 5), (3, 4, 2, 4, 3), (1, 2, 2, 2, 1)]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    t = trades(spark, [(0, 1, 1, "NONE", ""), (1, 2, 1, "BUY", "A"), (90, 3, 1, "SELL", "B")])
    assert s.add_trades(t) == {"received": 3, "inserted": 3, "duplicates": 0}
    assert s.add_trades(t) == {"received": 3, "inserted": 0, "duplicates": 3}
    assert s.load_trades("WINTEST", "2026-10-07", datetime(2026, 10, 7, 10, 0, 1), datetime(2026, 10, 7, 10, 1)).count() == 1
    s2 = store.Store(spark, str(tmp_path / "slices"))
    first = t.withColumn("source_row", F.col("sequence_no")).filter("sequence_no < 3")
    assert s2.add_slice(first, "f")["inserted"] == 2
    better = t.withColumns({"source_row": F.col("sequence_no"), "aggressor": F.lit("BUY"), "buyer_id": F.lit("Z")})
    assert s2.add_slice(better, "f") == {"received": 3, "inserted": 1, "duplicates": 2, "enriched": 1}
    assert {r.sequence_no: (r.aggressor, r.buyer_id) for r in s2.read("trades").collect()} == {1: ("BUY", "Z"), 2: ("BUY", "A"), 3: ("BUY", "Z")}
    s.upsert_instrument("WINTEST", 5)
    s.upsert_instrument("WINTEST", 1)
    assert one(s.read("instruments")).tick_size == 1
    s.upsert_instrument("OTHER", 2)
    assert {r.symbol: r.tick_size for r in s.read("instruments").collect()} == {"WINTEST": 1, "OTHER": 2}


def test_store_touches_only_its_partitions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    day = lambda d: datetime(2026, 10, d, 10, 0)
    t = trades(spark, [(0, 1, 1, "BUY", "A")], day(7)).unionAll(trades(spark, [(0, 1, 1, "NONE", "")], day(8))).withColumn("source_row", F.dayofmonth("session_date").cast("long"))
    assert s.add_slice(t, "f")["inserted"] == 2
    files = lambda: {str(p.relative_to(tmp_path)) for p in (tmp_path / "db" / "trades").rglob("*.parquet")}
    before = files()
    assert s.add_slice(t.filter("session_date = '2026-10-08'").withColumn("aggressor", F.lit("SELL")), "f")["enriched"] == 1
    assert {x for x in before if "10-07" in x} <= files() and not {x for x in before if "10-08" in x} & files()
    assert s.read("trades").filter("session_date = '2026-10-08'").collect()[0].aggressor == "SELL" and s.read("trades").count() == 2
    scan = s.load_trades("WINTEST", "2026-10-07")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in scan and "PushedFilters" in scan


def test_store_tables(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    refs = spark.createDataFrame([("007", 0, 60, 1, 2, 1, 2, 5, None, "x"), ("007", 60, 60, 2, 2, 1, 1, 5, 3, "x")], REFERENCES)
    assert s.add_references(refs) == {"received": 2, "inserted": 2, "duplicates": 0}
    assert s.add_references(refs)["inserted"] == 0
    assert [(r.symbol, r.start) for r in s.load_references("007", 60).collect()] == [("007", 0), ("007", 60)]
    q = spark.createDataFrame([("A", 1), ("A", 2)], "symbol string, score long")
    s.replace_part("session_quality", q, symbol="A")
    s.replace_part("session_quality", q.limit(1), symbol="B")
    s.replace_part("session_quality", q.limit(1), symbol="A")
    assert sorted((r.symbol, r.score) for r in s.read("session_quality").collect()) == [("A", 1), ("B", 1)]
    s.replace_part("session_quality", q.limit(0), symbol="A")
    assert [r.symbol for r in s.read("session_quality").collect()] == ["B"]
    with pytest.raises(ValueError):
        s.replace_part("research_index", q, symbol="A")
    s.replace_part("research_index", q, symbol="A", interval_seconds=60)
    assert s.load_research_index("A", 60).count() == 2
    t = trades(spark, [(0, 1, 1, "BUY", "A"), (1, 2, 1, "BUY", "A")])
    fake = trades(spark, [(2, 3, 1, "BUY", "A")], source="synthetic_x").unionAll(trades(spark, [(0, 1, 1, "BUY", "A")], datetime(2026, 10, 9, 10), source="synthetic_x"))
    for part in (t, fake, trades(spark, [(0, 1, 1, "BUY", "A")], symbol="WINLAB06")):
        s.add_trades(part)
    s.delete_sample()
    assert sorted(r.price_ticks for r in s.read("trades").collect()) == [1, 2]
    s.export_parquet(t, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def _lines(path, lines, encoding="utf-8"):
    path.write_bytes("\n".join(lines).encode(encoding))
    return str(path)


def test_every_line_counts(spark, tmp_path):
    body = ["WINX26;07/10/2026;10:00:00;1005;1", "", "WINX26;07/10/2026;10:00:01;1005;2", ";;;;", "WINX26;07/10/2026;10:00:02;1005;3"]
    path = _lines(tmp_path / "a.csv", ["Título", "", "Ativo;Data;Hora;Preço;Quantidade", *body])
    t = csv_trades.trades_or_error(csv_trades.read_trades(spark, path, tick_size=5)).orderBy("source_row").collect()
    assert [(r.source_row, r.quantity) for r in t] == [(4, 1), (6, 2), (8, 3)]


def test_encodings(spark, tmp_path):
    for name, codec, agent in (("utf-8", "utf-8", "Itaú €"), ("cp1252", "cp1252", "Itaú €"), ("latin-1", "latin-1", "Ita\x81ú")):
        plain = [f"WINX26,07/10/26,10:00:{k % 60:02d},A,1005,1,B,RLP" for k in range(60)]
        path = _lines(tmp_path / f"{name}.csv", [*plain, f"WINX26,07/10/26,10:01:00,{agent},1005,1,B,Comprador"], codec)
        last = csv_trades.read_trades(spark, path, tick_size=5).orderBy(F.desc("source_row")).first()
        assert last.buyer_id == agent, name
    bom = _lines(tmp_path / "bom.csv", ["\ufeffAtivo;Data;Hora;Preço;Qtd", "WINX26;07/10/2026;10:00:00;1005;1"])
    assert one(csv_trades.read_trades(spark, bom, tick_size=5)).symbol == "WINX26"


def test_first_alias_that_is_not_blank(spark, tmp_path):
    path = _lines(tmp_path / "a.csv", ["Ativo;Data;Hora;Preço;Quantidade;Qtd", "WINX26;07/10/2026;10:00:00;1005;;3", "WINX26;07/10/2026;10:00:01;1005;4;"])
    assert [r.quantity for r in csv_trades.read_trades(spark, path, tick_size=5).orderBy("source_row").collect()] == [3, 4]


def test_strict_rows(spark, tmp_path):
    good = "WINX26,07/10/26,10:00:00,A,1005,1,B,Comprador"
    path = _lines(tmp_path / "a.csv", [good, good + ",x", good.replace("WINX26", "WINZ26"), good.replace("1005", "205.935"), good.replace(",1,", ',"1,0",')])
    strict = csv_trades.read_trades(spark, path, tick_size=5, symbol="winx26", strict=True).orderBy("source_row").collect()
    assert [r.problem for r in strict] == [None, "wrong number of columns", "another symbol", "price is no multiple of the tick", "quantity is no positive integer"]
    loose = csv_trades.read_trades(spark, path, tick_size=5, symbol="winx26").orderBy("source_row").collect()
    assert [r.problem for r in loose] == [None] * 5 and loose[3].price_ticks == 41187


def test_exports_read_back(spark, tmp_path):
    t = trades(spark, [(0, 205_935, 1, "BUY", "A, \"x\""), (0.25, -3, 2, "RLP", None), (1, 100, 3, "SELL", "C"), (2, 1_000, 4, "NONE", None)])
    for ids in (False, True):
        out = str(tmp_path / f"out{ids}")
        store.export_csv(t, out, 0.001, ids)
        back = csv_trades.trades_or_error(csv_trades.read_trades(spark, out, tick_size=0.001))
        names = ["symbol", "ts", "session_date", "price_ticks", "quantity", "aggressor", "buyer_id", "seller_id"] + ["trade_id"] * ids
        assert sorted(map(str, back.select(names).collect())) == sorted(map(str, t.select(names).collect()))
        assert {r.quantity for r in back.filter("flags LIKE '%RLP'").collect()} == {2}


def test_order_over_parts(spark, monkeypatch):
    monkeypatch.setattr(csv_trades, "PART_LINES", 3)
    ordered = lambda secs: one(csv_trades.source_probe(trades(spark, [(s, 1, 1, "BUY", "A") for s in secs]).withColumn("source_row", F.col("sequence_no"))))
    assert ordered(range(10)).source_order == "ASCENDING" and ordered(range(10)).problem is None
    assert ordered(range(10, 0, -1)).source_order == "DESCENDING"
    mixed = ordered([0, 0, 0, 5, 5, 5, 1, 1])  # only borders of parts turn
    assert (mixed.source_order, mixed.problem) == ("MIXED", "order is MIXED")
    assert ordered([3, 3, 3, 3]).problem == "order is SAME_TIMESTAMP" and ordered([]).problem == "no trade with a time"
    two = trades(spark, [(0, 1, 1, "BUY", "A")]).unionAll(trades(spark, [(1, 1, 1, "BUY", "A")], symbol="Z")).withColumn("source_row", F.col("sequence_no"))
    assert one(csv_trades.source_probe(two)).problem == "more than one symbol"
    assert one(csv_trades.source_probe(two.filter("symbol = 'Z'"), "WINTEST")).problem == "another symbol"
    many = one(csv_trades.import_diagnostics(trades(spark, [(s, 1, 1, "BUY", "A") for s in (0, 1, 2, 1, 2, 3, 0)]), "sequence_no"))
    assert (many.source_order, many.inversions) == ("MIXED", 2)


def test_loads_resume_and_skip(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    lines = [f"WINX26,07/10/26,10:00:{k:02d},A,1005,1,B,Comprador" for k in range(5)]
    bad = _lines(tmp_path / "bad.csv", [*lines, "WINX26,07/10/26,10:00:09,A,1003,1,B,Comprador"])
    with pytest.raises(Exception, match="line 6"):
        s.load_file(bad, tick_size=5)
    path = _lines(tmp_path / "a.csv", lines)
    rows = csv_trades.read_trades(spark, path, tick_size=5).filter("source_row <= 2")
    s.add_slice(csv_trades.trades_or_error(rows), csv_trades.fingerprint(spark, path))  # what an interrupted load left
    done = s.load_file(path, tick_size=5)
    assert (done["state"], done["inserted"], done["duplicates"]) == ("COMPLETED", 3, 2)
    copy = _lines(tmp_path / "renamed.csv", lines)
    assert s.load_file(copy, tick_size=5)["state"] == "SKIPPED" and s.read("trades").count() == 5
    assert [r.state for r in s.latest_batches(3).collect()] == ["COMPLETED", "RUNNING", "FAILED"]
    assert csv_trades.fingerprint(spark, _lines(tmp_path / "turned.csv", lines[::-1])) != done["fingerprint"]


def test_minute_index_and_locators(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    lines = [f"WINX26,07/10/26,10:{k // 2:02d}:{k % 2:02d},A,1005,1,B,Comprador" for k in range(12)]
    path = _lines(tmp_path / "a.csv", lines)
    index, built = s.minute_index(path, tick_size=5)
    assert built and index.count() == 6
    assert not s.minute_index(path, tick_size=5)[1]
    assert s.minute_index(_lines(tmp_path / "b.csv", lines[:-1]), tick_size=5)[1]
    t0 = int((datetime(2026, 10, 7, 10) - datetime(1970, 1, 1)).total_seconds())
    r = one(csv_trades.locate_interval(index, t0 + 60, t0 + 180))
    assert (r.first_row, r.last_row, r.open_row, r.close_row, r.trades, r.minutes) == (3, 6, 3, 6, 4, 2)
    with pytest.raises(ValueError):
        csv_trades.locate_interval(index, t0 + 1, t0 + 60)
    starts = spark.createDataFrame([("WINX26", t0), ("WINX26", t0 + 120), ("WINX26", t0 + 6000)], "symbol string, start long")
    got = {r.start - t0: (r.status, r.first_row, r.last_row, r.trades) for r in csv_trades.locate_candles(index, starts, 120).collect()}
    assert got == {0: ("FOUND", 1, 4, 4), 120: ("FOUND", 5, 8, 4), 6000: ("NO_TRADES", None, None, 0)}


def test_ingest_resumes(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    t = trades(spark, [(k, 1, 1, "BUY", "A") for k in range(6)])
    run = lambda: ingest(spark.readStream.schema(TRADES).parquet(str(tmp_path / "in")), s, str(tmp_path / "cp")).awaitTermination()
    t.filter("sequence_no <= 3").write.parquet(str(tmp_path / "in"))
    run()
    assert s.read("trades").count() == 3
    t.filter("sequence_no >= 3").write.mode("append").parquet(str(tmp_path / "in"))  # the third again
    run()
    assert s.read("trades").count() == 6
    once = deduplicated(spark.readStream.schema(TRADES).parquet(str(tmp_path / "in")).withColumn("event_key", store.trade_key()))
    once.writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 6


def test_streams_equal_batches(spark, tmp_path):
    rows = [(k, 100 + k % 5, 1 + k % 7, "BUY" if k % 60 < 25 else "NONE", "A") for k in range(400)]
    t = trades(spark, rows)
    t.repartition(3).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(TRADES).parquet(str(tmp_path / "in"))
    q = streaming_candles(stream, 60, "0 seconds").writeStream.format("memory").queryName("c").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("c").collect()}
    want = {tuple(r) for r in build_candles(t, 60).drop("first_us", "last_us").collect()}
    assert got and got <= want and len(want - got) <= 1  # the last candle is still open
