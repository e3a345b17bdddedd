"""CSV exports of trades and of reference candles, read and checked in parallel.

Files are read as lines, which are numbered by block and place in the block, without sorting a file: so blank lines
count and every line is decoded by the file's own encoding. Only the first lines are looked at on the driver (separator, layout).
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import normalize as N
from ..schema import REFERENCES, order_key, with_start

PROBE_LINES = 50
WIDTH = 32
#: The columns of the exports without a header, and their words for the aggressor's side.
HEADERLESS = {8: ["symbol", "date", "time", "buyer", "price", "quantity", "seller", "aggressor"], 9: ["symbol", "date", "time", "trade_id", "buyer", "price", "quantity", "seller", "aggressor"]}
SIDES = {"comprador", "vendedor", "rlp", "indefinido", "undefined", ""}
PROFIT_FIELDS = {"aggressor", "buyer", "seller", "trade_id"}
#: Windows-1252 is ISO-8859-1 but for these bytes; the other five from 0x80 to 0x9F it doesn't have.
_NO_CP1252 = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
_CP1252 = bytes(k for k in range(0x80, 0xA0) if k not in _NO_CP1252)
#: Lines are compared with their predecessors in parts of so many lines, and then over the parts' borders.
PART_LINES = 1_000_000


@dataclass(frozen=True)
class Layout:
    encoding: str
    separator: str
    #: Each field's columns, the preferred alias first.
    fields: dict[str, tuple[int, ...]]
    header_line: int
    profit: bool
    #: Number of columns of a layout without a header, or 0.
    columns: int = 0

    @property
    def data_line(self) -> int:
        return self.header_line + 1


def _separator(lines: list[str]) -> str:
    """The separator that most lines have equally often, and of those the more frequent one."""

    def fit(s: str) -> tuple[int, int]:
        counts = Counter(n for x in lines if (n := len(next(csv.reader([x], delimiter=s), [])) - 1) > 0)
        return max(((k, n) for n, k in counts.items()), default=(0, 0))

    return max(",;\t|", key=fit)


def _bytes_as_text(c: Column) -> Column:
    return F.decode(c.cast("binary"), "ISO-8859-1")


def encoding_marks() -> list[Column]:
    """Aggregates over ``value`` that tell a file's encoding."""
    gaps = "[" + "".join(map(chr, _NO_CP1252)) + "]"
    return [F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(_bytes_as_text(F.col("value")).rlike(gaps)).alias("gaps")]


def encoding_told(marks) -> str:
    """UTF-8 if all lines of the file are, else cp1252 if it has all their bytes, else ISO-8859-1."""
    return "UTF-8" if marks["utf8"] is not False else "ISO-8859-1" if marks["gaps"] else "cp1252"


def encoding(spark: SparkSession, path: str) -> str:
    return encoding_told(spark.read.text(path).agg(*encoding_marks()).first())


def _decoded(encoding_: str) -> Column:
    if encoding_ == "UTF-8":
        return F.regexp_replace("value", "^﻿", "")
    text = _bytes_as_text(F.col("value"))
    return F.translate(text, _CP1252.decode("latin-1"), _CP1252.decode("cp1252")) if encoding_ == "cp1252" else text


def _known_side(row: list[str], at: dict[str, int]) -> bool:
    return row[at["aggressor"]].strip().lower() in SIDES and row[at["date"]].count("/") == 2 and row[at["time"]].count(":") == 2


def layout_of(lines: list[str], encoding_: str, needed: tuple[str, ...] = ("price", "quantity")) -> Layout:
    """Layout from the first physical lines: a header anywhere in them, or 8 or 9 columns without one."""
    separator = _separator(lines)
    for k, line in enumerate(lines, start=1):
        row = next(csv.reader([line], delimiter=separator), [])
        names = [N.header(x) for x in row]
        fields = {f: tuple(names.index(a) for a in aliases if a in names) for f, aliases in N.ALIASES.items()}
        fields = {f: at for f, at in fields.items() if at}
        if all(f in fields for f in needed) and ("timestamp" in fields or "date" in fields):
            return Layout(encoding_, separator, fields, k, bool(PROFIT_FIELDS & set(fields)))
        if len(row) in HEADERLESS and needed == ("price", "quantity"):
            at = {n: i for i, n in enumerate(HEADERLESS[len(row)])}
            if _known_side(row, at):
                return Layout(encoding_, separator, {n: (i,) for n, i in at.items()}, k - 1, True, len(row))
    raise ValueError("no known layout in the first lines")


def probe(spark: SparkSession, path: str, needed: tuple[str, ...] = ("price", "quantity")) -> Layout:
    """Layout from a file's first 50 lines."""
    found = encoding(spark, path)
    lines = [r["text"] for r in spark.read.text(path).select(_decoded(found).alias("text")).limit(PROBE_LINES).collect()]
    return layout_of(lines, found, needed)


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and block, and ``_place``, which rises with the lines of a block one by one."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_place", F.monotonically_increasing_id())


def blocks_of(lines: DataFrame) -> DataFrame:
    """A row for each block: its first place, lines, and the lines of the file's blocks before it."""
    sizes = lines.groupBy("_file", "_block").agg(F.min("_place").alias("_first"), F.count("*").alias("_lines"))
    return sizes.withColumn("_before", F.coalesce(F.sum("_lines").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def number_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """``value``, a line's bytes, and ``source_row``, its number in its file. Only a row for each block is shuffled and broadcast, no lines."""
    row = F.col("_before") + F.col("_place") - F.col("_first") + 1
    return lines.join(F.broadcast(blocks.drop("_lines")), ["_file", "_block"]).select("value", row.alias("source_row"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = placed_lines(spark, path)
    return number_lines(lines, blocks_of(lines))


def numbered(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    return cells_of(_lines(spark, path), layout)


def cells_of(lines: DataFrame, layout: Layout) -> DataFrame:
    """``_c0 ..`` as strings, ``_n_cells``, and ``source_row``, the number of the physical line. Lines of blank cells are left out.

    A cell that starts with a quote can hold the separator, and quotes as doubled ones, but no line end.
    """
    lines = lines.select(_decoded(layout.encoding).alias("_text"), "source_row")
    sep = re.escape(layout.separator)
    lines = lines.filter(F.col("source_row") > layout.header_line).filter(F.col("_text").rlike(f'[^\\s"{sep}]'))
    outside = F.regexp_replace("_text", f'(^|{sep})"(?:[^"]|"")*"', "$1")
    cells = F.length(outside) - F.length(F.replace(outside, F.lit(layout.separator), F.lit(""))) + 1
    schema = ", ".join(f"_c{k} string" for k in range(WIDTH))
    row = F.from_csv("_text", schema, {"sep": layout.separator, "quote": '"', "escape": '"'})
    return lines.select("source_row", cells.alias("_n_cells"), row.alias("_row")).select("source_row", "_n_cells", "_row.*")


def fingerprint(spark: SparkSession, path: str) -> str:
    return fingerprint_of(_lines(spark, path))


def fingerprint_of(lines: DataFrame) -> str:
    """Identity of a file's content, whatever its name: hash of its number of lines and of two sums of hashes of lines with their numbers."""
    lines = lines.select(F.length("value").alias("n"), *[F.xxhash64(F.lit(k), "value", "source_row").cast("decimal(38,0)").alias(f"h{k}") for k in range(2)])
    r = lines.agg(F.count("*"), F.sum("n"), F.sum("h0"), F.sum("h1")).first()
    return sha256(":".join(map(str, r)).encode()).hexdigest()


def _field(layout: Layout, name: str) -> Column | None:
    """A row's first cell that isn't blank, of the columns that stand for a field."""
    return F.coalesce(*[N.blank_to_null(F.col(f"_c{k}")) for k in layout.fields[name]]) if name in layout.fields else None


def _turns(trades: DataFrame, by: list[str], order: str) -> DataFrame:
    """``by``, up, down, first, last: rows whose time is later or earlier than that of the row before, and the ends of ``order``. Parts of the rows are
    compared on their own, and then the parts' borders, so that no task sorts all rows of a key."""
    c = F.col
    t = trades.filter("ts IS NOT NULL").select(*by, order, "ts", F.floor(c(order) / PART_LINES).alias("_part"))
    t = t.withColumn("_before", F.lag("ts").over(Window.partitionBy(*by, "_part").orderBy(order)))
    parts = t.groupBy(*by, "_part").agg(F.count_if(c("ts") > c("_before")).alias("up"), F.count_if(c("ts") < c("_before")).alias("down"), F.min_by("ts", order).alias("a"), F.max_by("ts", order).alias("b"), F.min(order).alias("first"), F.max(order).alias("last"))
    parts = parts.withColumn("_before", F.lag("b").over(Window.partitionBy(*by).orderBy("_part")))  # a row for each part
    return parts.groupBy(*by).agg((F.sum("up") + F.count_if(c("a") > c("_before"))).alias("up"), (F.sum("down") + F.count_if(c("a") < c("_before"))).alias("down"), F.min("first").alias("first"), F.max("last").alias("last"))


def _source_order() -> Column:
    up, down = F.coalesce("up", F.lit(0)), F.coalesce("down", F.lit(0))
    return F.when((down > 0) & (up == 0), "DESCENDING").when((up > 0) & (down == 0), "ASCENDING").when((up == 0) & (down == 0), "SAME_TIMESTAMP").otherwise("MIXED")


def read_trades(spark: SparkSession, path: str, *, tick_size: float, symbol: str | None = None, source: str = "csv", strict: bool = False) -> DataFrame:
    """Trades and what is wrong with a line in ``problem`` (null if nothing).

    A file in descending order is turned round: ``sequence_no`` counts the lines from its end. Equal
    lines are separate trades. ``flags`` keeps the side as written, so that RLP stays distinct. ``strict`` is the rule of bulk
    loads: lines have the layout's number of columns and the given symbol, quantities are digits, and a dot in a price is a decimal one.
    """
    if tick_size <= 0:
        raise ValueError("tick_size must be positive")
    layout = probe(spark, path)
    t = parsed(numbered(spark, path, layout), layout, tick_size=tick_size, symbol=symbol, source=source, strict=strict)
    return in_sequence(t, *source_order_of(t))


def parsed(rows: DataFrame, layout: Layout, *, tick_size: float, symbol: str | None = None, source: str = "csv", strict: bool = False) -> DataFrame:
    """The cells of ``rows`` as trades, with ``problem``, but no ``sequence_no``.

    What several columns are made of is a column of a step before, so that it is computed once for a line.
    """
    cells = rows.select("source_row", "_n_cells", *[_field(layout, n).alias(f"_{n}") for n in layout.fields])
    get = lambda n: F.col(f"_{n}") if n in layout.fields else None
    text = lambda n: F.lit(None).cast("string") if get(n) is None else get(n)
    number = N.profit_number if layout.profit and not strict else N.generic_number
    given = F.lit(symbol.strip().upper() if symbol else None).cast("string")
    texts = N.clock_texts(get("timestamp"), get("date"), get("time"))
    cells = cells.withColumns({"_own": F.upper(text("symbol")), "_number": number(get("price")), "_whole": N.generic_number(get("quantity")), "_side": N.side_text(text("aggressor")), **{f"_at{k}": x for k, x in enumerate(texts)}})
    cells = cells.withColumns({"_units": N.whole_number(F.col("_whole"), lambda n: n), **{f"_parts{k}": N.clock_parts(F.col(f"_at{k}")) for k in range(len(texts))}})
    ts = N.first_time([(F.col(f"_at{k}"), F.col(f"_parts{k}")) for k in range(len(texts))])
    quantity = F.col("_units")
    t = cells.select(
        "source_row",
        "_n_cells",
        "_own",
        F.coalesce(given, F.col("_own")).alias("symbol"),
        # an expression that isn't deterministic keeps later filters above this step: below, each mention of a column in them would parse the line again
        F.when(F.monotonically_increasing_id() >= 0, ts).alias("ts"),
        N.to_ticks(F.col("_number"), tick_size).alias("price_ticks"),
        F.when((quantity > 0) & (get("quantity").rlike(r"^[+]?\d+$") | F.lit(not strict)), quantity).alias("quantity"),
        text("trade_id").alias("trade_id"),
        N.side(F.col("_side")).alias("aggressor"),
        F.lit(source).alias("source"),
        text("buyer").alias("buyer_id"),
        text("seller").alias("seller_id"),
        F.when(text("aggressor").isNotNull(), F.concat(F.lit("raw_aggressor="), F.upper(text("aggressor")))).alias("flags"),
    )
    problem = F.when(F.col("symbol").isNull(), "no symbol").when(F.col("ts").isNull(), "no time").when(F.col("price_ticks").isNull(), "price is no multiple of the tick").when(F.col("quantity").isNull(), "quantity is no positive integer")
    if strict:
        cells = F.col("_n_cells") != F.lit(layout.columns) if layout.columns else F.lit(False)
        other = F.coalesce(F.col("_own") != given, F.lit(False))
        problem = F.when(cells, "wrong number of columns").when(other, "another symbol").otherwise(problem)
    # an expression that isn't deterministic keeps later filters above this step, so that no check runs on lines that are left out
    problem = F.when(F.monotonically_increasing_id() < 0, F.lit("")).otherwise(problem)
    return t.withColumns({"problem": problem, "session_date": F.col("ts").cast("date")}).drop("_own", "_n_cells")


def source_order_of(trades: DataFrame) -> tuple[str, int, int]:
    """The order of times, and the first and last line with one."""
    r = _turns(trades, [], "source_row").select(_source_order().alias("order"), "first", "last").first()  # one row
    return r["order"], r["first"] or 1, r["last"] or 1


def in_sequence(trades: DataFrame, source_order: str, first: int, last: int) -> DataFrame:
    """``sequence_no`` from 1 on; it counts a file in descending order from its end."""
    place = F.lit(last) - F.col("source_row") + 1 if source_order == "DESCENDING" else F.col("source_row") - F.lit(first - 1)
    return trades.withColumn("sequence_no", place.cast("long"))


def trades_or_error(trades: DataFrame) -> DataFrame:
    """The trades; a task fails at the first line that has a problem, naming it."""
    ok = F.assert_true(F.col("problem").isNull(), F.concat(F.lit("line "), F.col("source_row").cast("string"), F.lit(": "), F.col("problem")))
    return trades.filter(ok.isNull()).drop("problem")


#: A source needs so many distinct times.
LEAST_TIMES = 3


def source_probe(trades: DataFrame, symbol: str | None = None, order: str = "source_row", least_times: int = 1) -> DataFrame:
    """One row: rows, symbols, symbol, times (distinct ones), first_ts, last_ts, source_order and the ``problem`` that forbids slices of the source, or null:
    it must have trades of one symbol, the given one if any, in rising or falling order of time, and at ``least_times`` distinct times."""
    c = F.col
    t = trades.filter("ts IS NOT NULL")
    # distinct times by two aggregations, as a source has very many
    times = t.groupBy("ts").agg(F.count("*").alias("n")).agg(F.count("*").alias("times"))
    g = t.agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"), F.min("symbol").alias("symbol"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    g = g.crossJoin(F.broadcast(_turns(t, [], order))).crossJoin(F.broadcast(times)).withColumn("source_order", _source_order())  # one row each
    given = F.lit(symbol.strip().upper() if symbol else None).cast("string")
    problem = F.when(c("rows") == 0, "no trade with a time").when(c("symbols") > 1, "more than one symbol").when(F.coalesce(c("symbol"), given).isNull(), "no symbol").when(c("symbol") != given, "another symbol")
    problem = problem.when(~c("source_order").isin("ASCENDING", "DESCENDING"), F.concat(F.lit("order is "), c("source_order"))).when(c("times") < least_times, "too few distinct times")
    return g.select("rows", "symbols", F.coalesce(c("symbol"), given).alias("symbol"), "times", "first_ts", "last_ts", "source_order", problem.alias("problem"))


def read_references(spark: SparkSession, path: str, *, tick_size: float, interval: int, symbol: str | None = None, source: str = "reference_csv") -> DataFrame:
    """Reference candles. In the formatted export (volume as money beside quantity) prices and numbers are Brazilian."""
    layout = probe(spark, path, ("open", "high", "low", "close"))
    rows = numbered(spark, path, layout)
    names = layout.fields
    formatted = "quantity" in names and names.get("volume", (-1,))[0] in names["quantity"] and "trades" not in names
    if formatted:
        names["volume"] = names["volume"][:1]  # the other is money
    number = N.brazilian_number if formatted else N.generic_number
    get = lambda n: _field(layout, n)
    time = F.coalesce(get("time"), F.lit("00:00:00")) if "time" in names else F.lit("00:00:00")
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    ticks = [N.to_ticks(number(get(c)), tick_size).alias(f"{c}_ticks") for c in ("open", "high", "low", "close")]
    count = lambda n: N.whole_number(get(n), number) if n in names else F.lit(None).cast("long")
    out = rows.select(F.coalesce(F.lit(symbol).cast("string"), F.upper(get("symbol") if "symbol" in names else F.lit(None).cast("string"))).alias("symbol"), N.timestamp(get("timestamp"), get("date"), time).alias("ts"), *ticks, count("volume").alias("volume"), count("trades").alias("trades"))
    out = out.withColumns({"start": (F.floor(start / interval) * interval).cast("long"), "interval_seconds": F.lit(interval), "source": F.lit(source)})
    c = F.col
    ok = (c("high_ticks") >= F.greatest("open_ticks", "close_ticks")) & (c("low_ticks") <= F.least("open_ticks", "close_ticks"))
    twice = F.count("*").over(Window.partitionBy("symbol", "start")) > 1
    out = out.withColumn("ok", F.assert_true(F.coalesce(ok, F.lit(False)) & ~twice, F.concat_ws(" ", F.lit("bad or repeated candle"), "symbol", c("start").cast("string")))).filter("ok IS NULL")
    return out.select(*REFERENCES.fieldNames())


def import_diagnostics(trades: DataFrame, order: str = "source_row") -> DataFrame:
    """One row for each symbol: rows, source order with its inversions, known sides and agents, repeated trade ids."""
    c = F.col
    twice = trades.filter("trade_id IS NOT NULL").groupBy("symbol", "session_date", "trade_id").agg(F.count("*").alias("n")).groupBy("symbol").agg(F.sum(c("n") - 1).alias("repeated_trade_ids"))
    g = trades.groupBy("symbol").agg(
        F.count("*").alias("rows"),
        F.count_if(c("aggressor").isin("BUY", "SELL")).alias("known"),
        F.count_if((F.coalesce(F.trim("buyer_id"), F.lit("")) != "") & (F.coalesce(F.trim("seller_id"), F.lit("")) != "")).alias("agents"),
        F.count_if(c("flags").contains("RLP")).alias("rlp"),
    )
    g = g.join(_turns(trades, ["symbol"], order), "symbol", "left").join(twice, "symbol", "left")
    return g.select("symbol", "rows", _source_order().alias("source_order"), F.coalesce("down", F.lit(0)).alias("inversions"), F.coalesce("repeated_trade_ids", F.lit(0)).alias("repeated_trade_ids"), (c("known") / c("rows")).alias("known_share"), (c("agents") / c("rows")).alias("agents_share"), "rlp")


def minute_index(trades: DataFrame, minutes: int = 1, row: str = "source_row") -> DataFrame:
    """First and last line, trades, and the lines of the opening and closing trade of each minute (or M2, M5, M15)."""
    key = order_key()
    return with_start(trades, 60 * minutes).groupBy("symbol", "start").agg(F.min(row).alias("first_row"), F.max(row).alias("last_row"), F.count("*").alias("trades"), F.min_by(row, key).alias("open_row"), F.max_by(row, key).alias("close_row"))


def _located() -> list[Column]:
    traded = F.when(F.col("trades") > 0, F.col("minute"))
    return [F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), F.min_by("open_row", traded).alias("open_row"), F.max_by("close_row", traded).alias("close_row"), F.coalesce(F.sum("trades"), F.lit(0)).alias("trades"), F.count("trades").alias("minutes")]


def locate_interval(index: DataFrame, start: int, end: int) -> DataFrame:
    """Each symbol's lines in [start, end) (seconds, whole minutes), from a minute index."""
    if end <= start or start % 60 or end % 60:
        raise ValueError("the interval must be of whole minutes, and its end after its start")
    found = index.filter((F.col("start") >= start) & (F.col("start") < end)).withColumnRenamed("start", "minute")
    return found.groupBy("symbol").agg(*_located()).select("symbol", F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end"), "first_row", "last_row", "open_row", "close_row", "trades", "minutes")


def locate_candles(index: DataFrame, candles: DataFrame, interval: int) -> DataFrame:
    """The lines of each of ``candles`` (symbol, start), from a minute index; status FOUND or NO_TRADES."""
    if interval <= 0 or interval % 60:
        raise ValueError("the interval must be of whole minutes")
    # a candle is joined by its minutes: an equality, where an overlap of intervals would be a loop over all pairs
    wanted = candles.select("symbol", "start").distinct().withColumn("minute", F.explode(F.sequence(F.col("start"), F.col("start") + interval - 60, F.lit(60))))
    found = wanted.join(index.withColumnRenamed("start", "minute"), ["symbol", "minute"], "left").groupBy("symbol", "start").agg(*_located())
    return found.withColumn("status", F.when(F.col("minutes") > 0, "FOUND").otherwise("NO_TRADES"))
