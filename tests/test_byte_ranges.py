"""CSV files read by byte ranges."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickloom.sources import byte_ranges as B, csv_trades

T0 = int((datetime(2026, 10, 7, 10) - datetime(1970, 1, 1)).total_seconds())
HEADER = "Ativo;Data;Hora;Preço;Quantidade;Agente Comprador"


def rows(n, descending):
    out = [f'WINX26;07/10/2026;10:{k // 4:02d}:{k % 4 * 15:02d};{1000 + 5 * (k % 9)};{k + 1};"ação; ""{k}"""' for k in range(n)]
    return out[::-1] if descending else out


@pytest.mark.parametrize("descending", [False, True])
def test_a_filter_reads_only_its_minutes(spark, tmp_path, descending):
    B.register(spark)
    path, index = str(tmp_path / "a.csv"), str(tmp_path / "index")
    data = ("\r\n" if descending else "\n").join([HEADER, *rows(80, descending)]).encode()
    (tmp_path / "a.csv").write_bytes(data)
    B.write_index(spark, path, index, tick_size=5, block=300)
    extents = sorted(map(tuple, spark.read.parquet(index).select("byte_start", "byte_end", "trades").collect()))
    assert len(extents) == 20 and {x[2] for x in extents} == {4} and all(a[1] == b[0] for a, b in zip(extents, extents[1:]))
    assert data[extents[0][0] :].startswith(b"WINX26") and extents[-1][1] == len(data)
    full = csv_trades.read_trades(spark, path, tick_size=5).filter((F.col("ts") >= F.lit("2026-10-07 10:03:00").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2026-10-07 10:07:00").cast("timestamp_ntz")))
    names = ["symbol", "ts", "price_ticks", "quantity", "buyer_id", "problem"]
    want = sorted(map(str, full.select(names).collect()))
    got = B.read_minutes(spark, path, index, T0 + 180, T0 + 420, tick_size=5, block=300)
    assert sorted(map(str, got.select(names).collect())) == want and len(want) == 16
    # bytes outside of these minutes can be anything: they aren't read
    keep = [(r.byte_start, r.byte_end) for r in spark.read.parquet(index).filter(F.col("minute").between(T0 + 180, T0 + 419)).collect()]
    head = len(HEADER.encode()) + 1
    spoiled = bytearray(data[:head] + b"\x00" * (len(data) - head))
    for a, b in keep:
        spoiled[a:b] = data[a:b]
    lines = spark.read.format("csv_minutes").option("index", index).load(path)
    (tmp_path / "a.csv").write_bytes(bytes(spoiled))
    some = lines.filter((F.col("minute") >= T0 + 180) & (F.col("minute") < T0 + 420))
    assert sum(r.byte_end - r.byte_start for r in some.select("byte_start", "byte_end").collect()) == sum(b - a for a, b in keep)
    assert all(bytes(r.value).startswith(b"WINX26") for r in some.collect())


def test_partitions_are_runs_of_minutes(spark, tmp_path):
    B.register(spark)
    path, index = str(tmp_path / "a.csv"), str(tmp_path / "index")
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *rows(80, False)]))
    B.write_index(spark, path, index, tick_size=5)
    reader = B._Reader({"path": path, "index": index}, True)
    assert list(reader.pushFilters([B.GreaterThan(("minute",), T0), B.In(("minute",), (T0, T0 + 60, T0 + 120, T0 + 600)), B.EqualTo(("byte_start",), 3)])) == [B.EqualTo(("byte_start",), 3)]
    assert [[m[0] - T0 for m in p.minutes] for p in reader.partitions()] == [[60, 120], [600]]
    nothing = B._Reader({"path": path, "index": index}, True)
    list(nothing.pushFilters([B.EqualTo(("minute",), 5)]))
    assert [list(nothing.read(p)) for p in nothing.partitions()] == [[]]
    with pytest.raises(ValueError):
        B.read_minutes(spark, path, index, T0 + 1, T0 + 60, tick_size=5)


def test_blocks_share_no_line_and_lose_none(tmp_path):
    path = tmp_path / "x"
    data = b"".join(b"%d%s\n" % (k, b"x" * (k * 7 % 23)) for k in range(100)) + b"last without a break"
    path.write_bytes(data)
    for block in (1, 2, 7, 64, 10_000):
        got = [x for k in range(0, len(data), block) for x in B._lines(str(path), k, min(k + block, len(data)))]
        assert [x[0] for x in got] == data.split(b"\n") and got[-1][2] == len(data)


def test_unordered_files_have_no_index(spark, tmp_path):
    B.register(spark)
    lines = rows(8, False)
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *lines[4:], *lines[:4], *lines[4:]]))
    with pytest.raises(ValueError, match="order of time"):
        B.write_index(spark, str(tmp_path / "a.csv"), str(tmp_path / "index"), tick_size=5)
