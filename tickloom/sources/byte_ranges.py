"""CSV exports read by byte ranges: a Python data source that seeks the minutes a filter asks for.

``csv_lines`` reads a file's lines with their byte extents, a partition for each block of bytes; from it the minute index with extents
is built. ``csv_minutes`` reads by that index: comparisons of ``minute`` are pushed down, and only the extents of the minutes that are left are read, a partition for
each run of neighbouring ones. Files are opened by pyarrow on the executors, so the path must be one that it knows (local, HDFS, S3 and the like).
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import csv_trades
from .csv_trades import Layout

BLOCK = 64 << 20
#: Lines are handed on in batches of so many.
LINES = 10_000
LINE = "value binary, byte_start bigint, byte_end bigint"
MINUTE = "value binary, byte_start bigint, byte_end bigint, minute bigint"


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return system, name


def _lines(path: str, start: int, end: int, at_line: bool = False) -> Iterator[tuple[bytes, int, int]]:
    """The lines that begin in [start, end), with their extents; a line's end is after its line break. ``at_line``: one begins at ``start``."""
    system, name = _open(path)
    with io.BufferedReader(system.open_input_file(name), 1 << 20) as f:
        at = start
        if start and not at_line:  # the line that holds the byte before belongs to the block before
            f.seek(start - 1)
            at = start - 1 + len(f.readline())
        f.seek(at)
        while at < end:
            line = f.readline()
            if not line:
                return
            yield line.rstrip(b"\r\n"), at, at + len(line)
            at += len(line)


@dataclass
class Range(InputPartition):
    start: int
    end: int
    #: (minute, start, end) of the minutes in the range.
    minutes: tuple[tuple[int, int, int], ...] = ()


class _Reader(DataSourceReader):
    def __init__(self, options, ranges: bool):
        self.path, self.block, self.index = options["path"], int(options.get("block", BLOCK)), options.get("index")
        self.ranges, self.tests = ranges, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        compare = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v}
        for f in filters:
            if self.ranges and type(f) in compare and f.attribute == ("minute",):
                self.tests.append((compare[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        if not self.ranges:
            system, name = _open(self.path)
            size = system.get_file_info(name).size
            return [Range(k, min(k + self.block, size)) for k in range(0, size, self.block)]
        import pyarrow.parquet as pq

        system, name = _open(self.index)
        rows = pq.read_table(name, filesystem=system, columns=["minute", "byte_start", "byte_end"]).to_pylist()  # a row for each minute of the file
        wanted = sorted((r["byte_start"], r["byte_end"], r["minute"]) for r in rows if all(test(r["minute"], v) for test, v in self.tests))
        out: list[Range] = []
        for a, b, m in wanted:
            if out and out[-1].end == a and b - out[-1].start <= self.block:
                out[-1] = Range(out[-1].start, b, (*out[-1].minutes, (m, a, b)))
            else:
                out.append(Range(a, b, ((m, a, b),)))
        return out or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        minutes = iter(part.minutes)
        minute = next(minutes, None)
        names = ["value", "byte_start", "byte_end"] + ["minute"] * self.ranges

        def flush() -> pa.RecordBatch:
            columns = list(zip(*held))
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for line, a, b in _lines(self.path, part.start, part.end, self.ranges):
            while minute and a >= minute[2]:
                minute = next(minutes, None)
            held.append((line, a, b, minute[0]) if self.ranges else (line, a, b))
            if len(held) == LINES:
                yield flush()
                held = []
        if held:
            yield flush()


class CsvLines(DataSource):
    """Options: ``path``, and ``block``, the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "csv_lines"

    def schema(self) -> str:
        return LINE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, False)


class CsvMinutes(DataSource):
    """Options: ``path``, ``index`` (a Parquet folder that ``write_index`` made), and ``block``."""

    @classmethod
    def name(cls) -> str:
        return "csv_minutes"

    def schema(self) -> str:
        return MINUTE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, True)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CsvLines)
    spark.dataSource.register(CsvMinutes)


def _parsed(lines: DataFrame, layout: Layout, **options) -> DataFrame:
    """Trades of lines that are numbered by their first byte, which stands as ``source_row``."""
    # the first line begins at byte 0; a header's place is its last byte's
    text = lines.select(F.col("value").cast("string").alias("value"), F.col("byte_start").alias("source_row"))
    return csv_trades.parsed(csv_trades.cells_of(text, layout), layout, **options)


def header_end(spark: SparkSession, path: str, layout: Layout) -> int:
    """The last byte of the header, so that data lines begin after it; -1 without one."""
    if not layout.header_line:
        return -1
    rows = spark.read.format("csv_lines").load(path).select("byte_end").orderBy("byte_end").limit(layout.header_line).collect()
    return rows[-1]["byte_end"] - 1


def write_index(spark: SparkSession, path: str, index: str, *, tick_size: float, symbol: str | None = None, block: int = BLOCK) -> None:
    """The minute index of a file in order of time: minute (epoch seconds), byte_start, byte_end, trades."""
    layout = csv_trades.probe(spark, path)
    layout = replace(layout, header_line=header_end(spark, path, layout))
    lines = spark.read.format("csv_lines").option("block", block).load(path)
    t = _parsed(lines, layout, tick_size=tick_size, symbol=symbol).filter("ts IS NOT NULL")
    if csv_trades.source_order_of(t)[0] == "MIXED":
        raise ValueError("the file isn't in order of time, so a minute is no range of bytes")
    at = F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 60) * 60
    ends = lines.select(F.col("byte_start").alias("source_row"), "byte_end")
    found = t.select("source_row", at.alias("minute")).join(ends, "source_row")
    rows = found.groupBy("minute").agg(F.min("source_row").alias("byte_start"), F.max("byte_end").alias("byte_end"), F.count("*").alias("trades"))
    rows.coalesce(1).write.mode("overwrite").parquet(index)  # a row for each minute


def read_minutes(spark: SparkSession, path: str, index: str, start: int, end: int, *, tick_size: float, symbol: str | None = None, block: int = BLOCK) -> DataFrame:
    """Trades of the minutes in [start, end) (epoch seconds); ``source_row`` is the line's first byte. Other bytes of the file are not read."""
    if start % 60 or end % 60 or end <= start:
        raise ValueError("the interval must be of whole minutes, and its end after its start")
    layout = replace(csv_trades.probe(spark, path), header_line=-1)  # an index has no minute for the header
    lines = spark.read.format("csv_minutes").option("index", index).option("block", block).load(path)
    return _parsed(lines.filter((F.col("minute") >= start) & (F.col("minute") < end)), layout, tick_size=tick_size, symbol=symbol)
