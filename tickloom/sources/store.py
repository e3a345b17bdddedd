"""Trades, references and derived tables as partitioned Parquet.

An import appends the rows whose key isn't there, and looks for keys only in the partitions of its own symbols and days. What
changes rows rewrites the partitions it touches by dynamic partition overwrite. One writer at a time for each table.
"""

from __future__ import annotations

import uuid
from decimal import Decimal
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..schema import REFERENCES, TRADES, is_rlp
from . import csv_trades

PARTITIONS = {"trades": ["symbol", "session_date"], "reference_candles": ["symbol"], "session_quality": ["symbol"], "research_index": ["symbol", "interval_seconds"], "minute_index": ["fingerprint"], "instruments": ["symbol"], "import_batches": [], "import_heads": [], "import_blocks": [], "quarantine": ["symbol", "session_date"], "live_candles": ["interval_seconds", "symbol", "session_date"], "live_marks": []}
#: Types of the partition columns, which folder names don't tell.
TYPES = {"symbol": T.StringType(), "session_date": T.DateType(), "interval_seconds": T.IntegerType(), "fingerprint": T.StringType()}
COLUMNS = {
    "trades": TRADES.fieldNames() + ["event_key", "source_row"],
    "reference_candles": REFERENCES.fieldNames() + ["reference_key"],
}
TRADE_ROW = T.StructType(TRADES.fields + [T.StructField("event_key", T.StringType()), T.StructField("source_row", T.LongType())])
BATCH = "batch_id string, fingerprint string, path string, state string, received long, inserted long, enriched long, message string, at timestamp"
#: Up to so many partitions of a batch are named in a scan's filter; beyond, they are joined with it.
NAMED = 1000
#: One slice for a deep analysis spans so many seconds at most.
SLICE_SECONDS = 3 * 3600
#: A file of trades has so many rows at most.
FILE_ROWS = 5_000_000


def trade_key() -> Column:
    """Identity of an imported trade; its place in the file counts, so equal lines stay separate."""
    parts = ["symbol", "ts", "price_ticks", "quantity", "trade_id", "source", "sequence_no"]
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]), 256)


def slice_key(fingerprint: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(fingerprint), F.col("source_row").cast("string")), 256)


def reference_key() -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("symbol", "start", "interval_seconds", "source")]), 256)


def new_rows(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The first of each key's ``rows`` that isn't stored yet."""
    return rows.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def enriched(stored: DataFrame, rows: DataFrame, key: str = "event_key") -> DataFrame:
    """``stored`` and new ``rows``. A stored row takes a side only where it has none, and agents and flags
    only where they are blank; with a column ``change``: inserted, enriched or kept."""
    rows = rows.dropDuplicates([key])
    names = stored.columns
    both = stored.withColumn("_in", F.lit(True)).alias("a").join(rows.select(*[F.col(c).alias(f"_{c}") for c in names]).withColumn("_new", F.lit(True)), F.col(key) == F.col(f"_{key}"), "full_outer")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    gains = {c: blank(c) & ~blank(f"_{c}") for c in ("buyer_id", "seller_id", "flags") if c in names}
    gains["aggressor"] = (F.col("aggressor") == "NONE") & F.col("_aggressor").isin("BUY", "SELL")
    known = F.col("_in").isNotNull()
    some = F.lit(False)
    for g in gains.values():
        some = some | F.coalesce(g, F.lit(False))
    change = F.when(~known, "inserted").when(some, "enriched").otherwise("kept")
    pick = lambda c: F.when(known, F.when(gains[c], F.col(f"_{c}")).otherwise(F.col(c)) if c in gains else F.coalesce(c, f"_{c}")).otherwise(F.col(f"_{c}"))
    return both.select(*[pick(c).alias(c) for c in names], change.alias("change"))


def observed(seen: Observation) -> dict[str, int]:
    """What a write observed. Where Spark finds out on the way that there are no rows, it drops the step, and the observation is an empty row, which
    PySpark can't convert."""
    try:
        return seen.get
    except Py4JJavaError as e:
        if "assertion failed" not in str(e):
            raise
        return {}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._files(path)
        return fs.exists(p)

    def _remove_partition(self, table: str, **part) -> None:
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        fs, p = self._files("/".join([self._path(table), *[f"{k}={escape(str(part[k]))}" for k in PARTITIONS[table] if k in part]]))
        fs.delete(p, True)

    def read(self, table: str) -> DataFrame | None:
        path = self._path(table)
        if not self._exists(path):
            return None
        keys = PARTITIONS[table]
        if table in ("trades", "quarantine"):
            return self.spark.read.schema(TRADE_ROW).parquet(path)
        found = self.spark.read.option("mergeSchema", True).parquet(path).schema if table == "import_batches" else self.spark.read.parquet(path).schema
        fields = [T.StructField(f.name, TYPES[f.name] if f.name in keys else f.dataType) for f in found]
        return self.spark.read.schema(T.StructType(fields)).parquet(path)

    def _write(self, table: str, rows: DataFrame, mode: str) -> None:
        """Appends, or replaces the partitions that ``rows`` has."""
        keys = PARTITIONS[table]
        if table in ("trades", "quarantine"):
            rows = rows.select([(F.col(c) if c in rows.columns else F.lit(None)).cast(TRADE_ROW[c].dataType).alias(c) for c in COLUMNS["trades"]])
            rows = rows.repartition(*keys, F.hour("ts")).sortWithinPartitions(*keys, "ts", "sequence_no")  # a hot day is sorted by many tasks
        out = rows.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).option("partitionOverwriteMode", "dynamic")
        (out.partitionBy(*keys) if keys else out).parquet(self._path(table))

    def _staged(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """``rows`` written beside the tables: a table can't be read while it is being replaced."""
        path = f"{self.root}/_staging/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), path

    def _staged_and_counted(self, rows: DataFrame, **counts: Column) -> tuple[DataFrame, str, dict[str, int]]:
        """``rows`` staged, and ``counts`` that the write itself observes: no pass of their own."""
        seen = Observation()
        staged, path = self._staged(rows.observe(seen, *[F.coalesce(x, F.lit(0)).alias(k) for k, x in counts.items()]))
        return staged, path, {k: 0 for k in counts} | observed(seen)

    def _drop_staged(self, path: str) -> None:
        fs, p = self._files(path)
        fs.delete(p, True)

    def partitions_of(self, table: str, rows: DataFrame) -> DataFrame | None:
        """The stored rows of the symbols (and days) that ``rows`` has; other partitions are not read."""
        old = self.read(table)
        if old is None:
            return None
        keys = [k for k in PARTITIONS[table] if k in ("symbol", "session_date")]
        parts = rows.select(*keys).distinct()
        found = parts.take(NAMED + 1)
        if len(found) > NAMED:
            return old.join(parts, keys, "left_semi")
        days: dict[str, list] = {}
        for r in found:
            days.setdefault(r["symbol"], []).append(r["session_date"] if "session_date" in keys else None)
        named = [(F.col("symbol") == s) & F.col("session_date").isin(d) if "session_date" in keys else F.col("symbol") == s for s, d in days.items()]
        return old.filter(reduce(lambda a, b: a | b, named, F.lit(False)))

    # imports

    def add(self, table: str, rows: DataFrame, key: str) -> dict[str, int]:
        """Appends rows of new keys; received, inserted and duplicates. ``rows`` is evaluated once, and counted by the writes."""
        staged, path, n = self._staged_and_counted(rows, received=F.count("*"))
        received = n["received"]
        if not received:
            self._drop_staged(path)
            return {"received": 0, "inserted": 0, "duplicates": 0}
        fresh, doubts = self._fresh(self.partitions_of(table, staged), staged, key)
        seen = Observation()
        self._write(table, fresh.observe(seen, F.count("*").alias("inserted")), "append")
        self._drop_staged(path)
        self._drop_staged(doubts)
        inserted = observed(seen).get("inserted", 0)
        return {"received": received, "inserted": inserted, "duplicates": received - inserted}

    def _fresh(self, old: DataFrame | None, rows: DataFrame, key: str) -> tuple[DataFrame, str]:
        """The first of each key's ``rows`` that isn't among ``old``. Hashes of keys tell which rows may be repeated or stored; only these are compared,
        so a batch of new rows is neither shuffled nor sorted whole by its keys. With the folder of the doubtful hashes."""
        hashed = lambda df, stored: df.select(F.xxhash64(key).alias("_hash"), F.lit(stored).alias("_stored"))
        every = hashed(rows, 0) if old is None else hashed(rows, 0).unionByName(hashed(old, 1))
        found = every.groupBy("_hash").agg(F.count("*").alias("n"), F.sum("_stored").alias("stored")).filter("n > stored AND n > 1").select("_hash")
        doubtful, path, n = self._staged_and_counted(found, n=F.count("*"))
        if not n["n"]:
            return rows, path
        rows = rows.withColumn("_hash", F.xxhash64(key))
        mine = rows.join(doubtful, "_hash", "left_semi").drop("_hash")
        again = mine.dropDuplicates([key]) if old is None else new_rows(old, mine, key)
        return rows.join(doubtful, "_hash", "left_anti").drop("_hash").unionByName(again), path

    def add_trades(self, trades: DataFrame) -> dict[str, int]:
        return self.add("trades", trades.withColumn("event_key", trade_key()), "event_key")

    def add_slice(self, trades: DataFrame, fingerprint: str) -> dict[str, int]:
        """New trades of a file, and sides, agents and flags of those stored without; touched days are rewritten."""
        rows = trades.withColumn("event_key", slice_key(fingerprint))
        if self.read("trades") is None:
            return self.add("trades", rows, "event_key") | {"enriched": 0}
        fit = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(TRADE_ROW[c].dataType).alias(c) for c in COLUMNS["trades"]])
        staged, first, n = self._staged_and_counted(fit, received=F.count("*"))
        # whole partitions are rewritten, so all their rows are needed, but no other partition's
        old = self.partitions_of("trades", staged).select(*COLUMNS["trades"])
        merged, second, changed = self._staged_and_counted(enriched(old, staged), inserted=F.count_if(F.col("change") == "inserted"), enriched=F.count_if(F.col("change") == "enriched"))
        if changed["enriched"]:
            self._write("trades", merged.drop("change"), "overwrite")
        elif changed["inserted"]:
            self._write("trades", merged.filter("change = 'inserted'").drop("change"), "append")
        for path in (first, second):
            self._drop_staged(path)
        return {"received": n["received"], "inserted": changed["inserted"], "duplicates": n["received"] - changed["inserted"], "enriched": changed["enriched"]}

    def add_references(self, references: DataFrame) -> dict[str, int]:
        return self.add("reference_candles", references.withColumn("reference_key", reference_key()), "reference_key")

    def load_file(self, path: str, *, tick_size: float, symbol: str | None = None, source: str = "csv", strict: bool = True, step_rows: int = 5_000_000) -> dict:
        """Loads a file once, whatever its name, by blocks; a load that broke off goes on at its first unfinished block (``bulk_load``)."""
        from .bulk_load import load

        return load(self, path, tick_size=tick_size, symbol=symbol, source=source, strict=strict, step_rows=step_rows)

    def state(self, fingerprint: str) -> str | None:
        """The last state of a file's load."""
        batches = self.read("import_batches")
        if batches is None:
            return None
        return batches.filter(F.col("fingerprint") == fingerprint).agg(F.max_by("state", "at")).first()[0]

    def record_batch(self, batch: DataFrame) -> None:
        self._write("import_batches", batch.coalesce(1), "append")

    def latest_batches(self, limit: int = 20) -> DataFrame | None:
        batches = self.read("import_batches")
        return None if batches is None else batches.orderBy(F.desc("at"), F.desc("batch_id")).limit(limit)

    # changes

    def upsert_instrument(self, symbol: str, tick_size: float) -> None:
        self._write("instruments", self.spark.createDataFrame([(symbol, float(tick_size))], "symbol string, tick_size double"), "overwrite")

    def replace_part(self, table: str, rows: DataFrame, **part) -> None:
        """Replaces all rows of one partition (a symbol, and an interval where the table has them) by ``rows``."""
        if set(part) != set(PARTITIONS[table]):
            raise ValueError(f"{table} is replaced by {' and '.join(PARTITIONS[table])}")
        staged, path = self._staged(rows.withColumns({k: F.lit(v).cast(TYPES[k]) for k, v in part.items()}))
        if staged.isEmpty():
            self._remove_partition(table, **part)
        else:
            self._write(table, staged, "overwrite")
        self._drop_staged(path)

    def delete_sample(self, symbol: str = "WINLAB06") -> None:
        """Drops the sample's symbol, and synthetic trades of other symbols, whose days are rewritten without them."""
        old = self.read("trades")
        if old is None:
            return
        self._remove_partition("trades", symbol=symbol)
        old = self.read("trades")
        fake = F.coalesce(F.lower("source").startswith("synthetic"), F.lit(False))
        days = old.filter(fake).groupBy("symbol", "session_date").agg(F.lit(True).alias("some"))
        held = [tuple(r) for r in days.select("symbol", "session_date").collect()]  # days of synthetic data
        if not held:
            return
        staged, path = self._staged(old.join(days, ["symbol", "session_date"], "left_semi").filter(~fake))
        left = {tuple(r) for r in staged.select("symbol", "session_date").distinct().collect()}
        if left:
            self._write("trades", staged, "overwrite")
        for s, d in held:
            if (s, d) not in left:
                self._remove_partition("trades", symbol=s, session_date=d)
        self._drop_staged(path)

    # scans

    def load_trades(self, symbol: str, session_date: str | None = None, start=None, end=None) -> DataFrame:
        """Trades of a symbol, of a day, in [start, end); partitions and row groups that can't match are skipped."""
        t = self.read("trades").filter(F.col("symbol") == symbol)
        if session_date:
            t = t.filter(F.col("session_date") == F.lit(session_date).cast("date"))
        if start is not None:
            t = t.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("session_date") >= F.lit(start).cast("date")))
        if end is not None:
            t = t.filter((F.col("ts") < F.lit(end).cast("timestamp_ntz")) & (F.col("session_date") <= F.lit(end).cast("date")))
        return t

    def load_slice(self, symbol: str, start, end) -> DataFrame:
        """Trades of a symbol in [start, end), at most three hours, for a deep analysis."""
        if not symbol.strip():
            raise ValueError("a slice needs a symbol")
        if end <= start:
            raise ValueError("a slice's end must be after its start")
        if (end - start).total_seconds() > SLICE_SECONDS:
            raise ValueError("a slice spans three hours at most")
        return self.load_trades(symbol.strip().upper(), start=start, end=end)

    def load_references(self, symbol: str, interval: int | None = None) -> DataFrame:
        """Reference candles of a symbol by start."""
        r = self.read("reference_candles").filter(F.col("symbol") == symbol)
        return (r if interval is None else r.filter(F.col("interval_seconds") == interval)).orderBy("start", "source")

    def load_research_index(self, symbol: str, interval: int) -> DataFrame:
        return self.read("research_index").filter((F.col("symbol") == symbol) & (F.col("interval_seconds") == interval))

    def minute_index(self, path: str, *, tick_size: float, symbol: str | None = None) -> tuple[DataFrame, bool]:
        """(the minute index of a file, whether it was built now). It is kept under the content's fingerprint, so a changed file has none."""
        mark = csv_trades.fingerprint(self.spark, path)
        stored = self.read("minute_index")
        built = stored is None or stored.filter(F.col("fingerprint") == mark).isEmpty()
        if built:
            rows = csv_trades.read_trades(self.spark, path, tick_size=tick_size, symbol=symbol).filter("ts IS NOT NULL")
            self.replace_part("minute_index", csv_trades.minute_index(rows), fingerprint=mark)
            if csv_trades.fingerprint(self.spark, path) != mark:
                self._remove_partition("minute_index", fingerprint=mark)
                raise ValueError("the file changed while its index was built")
        return self.read("minute_index").filter(F.col("fingerprint") == mark).drop("fingerprint"), built

    # exports

    def export_parquet(self, trades: DataFrame, path: str) -> None:
        """A folder for each symbol and day, its rows in order."""
        keys = PARTITIONS["trades"]
        trades.repartition(*keys).sortWithinPartitions(*keys, "ts", "sequence_no").write.option("compression", "zstd").partitionBy(*keys).parquet(path)

    def export_csv(self, trades: DataFrame, path: str, tick_size: float, trade_ids: bool = False) -> None:
        export_csv(trades, path, tick_size, trade_ids)


def canonical_columns(tick_size: float, trade_ids: bool = False) -> list[Column]:
    """The eight columns of the headerless layout (nine with trade ids), such that reading them gives the trades back.

    A price of three decimals gets a fourth, as readers take 205.935 for 205935; times have a fraction only where they need it.
    """
    price = F.regexp_replace((F.col("price_ticks").cast("decimal(20,0)") * F.lit(Decimal(str(tick_size)))).cast("decimal(38,8)").cast("string"), r"\.?0+$", "")
    price = F.when(price.isin("", "-", "-0"), "0").when(price.rlike(r"\.\d{3}$"), F.concat(price, F.lit("0"))).otherwise(price)
    written = F.lower(F.regexp_extract(F.coalesce("flags", F.lit("")), "raw_aggressor=([^;]*)", 1))
    side = F.when(F.col("aggressor") == "BUY", "Comprador").when(F.col("aggressor") == "SELL", "Vendedor").when(is_rlp(), "RLP").when(written.isin("indefinido", "undefined"), F.initcap(written)).otherwise("")
    second = F.date_format("ts", "HH:mm:ss")
    fine = F.date_format("ts", "HH:mm:ss.SSSSSS")
    time = F.when(fine.endswith(".000000"), second).otherwise(fine)
    c = F.col
    columns = {"symbol": c("symbol"), "date": F.date_format("ts", "dd/MM/yy"), "time": time, "trade_id": c("trade_id"), "buyer": c("buyer_id"), "price": price, "quantity": c("quantity").cast("string"), "seller": c("seller_id"), "aggressor": side}
    return [columns[k].alias(k) for k in csv_trades.HEADERLESS[9 if trade_ids else 8]]


def export_csv(trades: DataFrame, path: str, tick_size: float, trade_ids: bool = False) -> None:
    """Trades as headerless CSV files of which each holds a range of times, in order."""
    # texts are made behind the exchange, which samples its input and would make them twice
    rows = trades.repartitionByRange("ts", "sequence_no").sortWithinPartitions("ts", "sequence_no").select(*canonical_columns(tick_size, trade_ids))
    rows.write.option("emptyValue", "").option("escape", '"').csv(path)
