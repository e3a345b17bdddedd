"""Loads of large CSV files by blocks, with a ledger.

A file is read once: its lines are staged as Parquet with their block, and that write itself observes what the encoding is told by. Steps of
whole blocks are then parsed from the stage and added to the store, and each has a row in the ledger when it is done. A load that broke off
is known again by the file's path, size and time, without reading the file, and goes on at the first step that isn't done.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict
from datetime import datetime, timezone
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Observation, Window, functions as F

from . import csv_trades
from .csv_trades import Layout

if TYPE_CHECKING:
    from .store import Store

#: What is known of a file once it is staged.
HEAD = "source string, path string, fingerprint string, folder string, layout string, source_order string, first_row long, last_row long, steps int, rows long, at timestamp"
#: A row for each step that is done.
BLOCK = "source string, fingerprint string, step int, rows long, received long, inserted long, enriched long, seconds double, at timestamp"


def now() -> datetime:
    return datetime.now(timezone.utc)


def source_of(store: Store, path: str) -> str:
    """Identity of a file as it stands there, from its listing."""
    files = store.spark.read.format("binaryFile").load(path)
    return str(files.agg(F.concat_ws(":", F.sum("length").cast("string"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).cast("string"))).first()[0])


def _head(store: Store, **match) -> dict | None:
    heads = store.read("import_heads")
    if heads is None:
        return None
    for k, v in match.items():
        heads = heads.filter(F.col(k) == v)
    found = heads.orderBy(F.desc("at")).first()
    return found.asDict() if found else None


def stage(store: Store, path: str, place: str, step_rows: int, **options) -> dict:
    """The file's lines as Parquet, and its head."""
    spark, folder = store.spark, f"{store.root}/_loads/{uuid.uuid4().hex}"
    seen = Observation()
    lines = csv_trades.placed_lines(spark, path)
    told = lines.observe(seen, *csv_trades.encoding_marks(), F.count("*").alias("rows"))
    told.withColumn("value", F.col("value").cast("binary")).write.option("compression", "zstd").parquet(f"{folder}/lines")
    encoding = csv_trades.encoding_told(seen.get)
    raw = spark.read.parquet(f"{folder}/lines").withColumn("value", F.col("value").cast("string"))
    # a row for each block: lines are numbered over all files of a folder, and steps of about ``step_rows`` rows without gaps
    blocks = csv_trades.blocks_of(raw).withColumn("_before", F.coalesce(F.sum("_lines").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("step", F.dense_rank().over(Window.orderBy(F.floor(F.col("_before") / step_rows))) - 1)
    blocks.write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    numbered = csv_trades.number_lines(raw, blocks)
    first = numbered.filter(F.col("source_row") <= csv_trades.PROBE_LINES).orderBy("source_row").select(csv_trades._decoded(encoding).alias("text")).collect()
    layout = csv_trades.layout_of([r["text"] for r in first], encoding)
    trades = csv_trades.parsed(csv_trades.cells_of(numbered, layout), layout, **options)
    order, lo, hi = csv_trades.source_order_of(trades)
    steps = [r["step"] for r in blocks.select("step").distinct().collect()]  # at most a number for each ``step_rows`` rows
    head = {"source": place, "path": path, "fingerprint": csv_trades.fingerprint_of(numbered), "folder": folder, "layout": json.dumps(asdict(layout)), "source_order": order, "first_row": lo, "last_row": hi, "steps": max(steps, default=-1) + 1, "rows": seen.get["rows"], "at": now()}
    store._write("import_heads", spark.createDataFrame([head], HEAD).coalesce(1), "append")
    return head


def step_lines(store: Store, head: dict, step: int) -> DataFrame:
    """The numbered lines of one step; the stage's row groups of other blocks are skipped by their statistics."""
    spark = store.spark
    blocks = spark.read.parquet(f"{head['folder']}/blocks").filter(F.col("step") == step)
    ends = blocks.agg(F.min("_block"), F.max("_block"), F.min("_file"), F.max("_file")).first()
    raw = spark.read.parquet(f"{head['folder']}/lines")
    raw = raw.filter(F.col("_block").between(ends[0], ends[1]) & F.col("_file").between(ends[2], ends[3])) if ends[0] is not None else raw.limit(0)
    return csv_trades.number_lines(raw.withColumn("value", F.col("value").cast("string")), blocks.drop("step"))


def _layout(text: str) -> Layout:
    found = json.loads(text)
    return Layout(**found | {"fields": {k: tuple(v) for k, v in found["fields"].items()}})


def done_steps(store: Store, fingerprint: str) -> set[int]:
    blocks = store.read("import_blocks")
    return set() if blocks is None else {r["step"] for r in blocks.filter(F.col("fingerprint") == fingerprint).select("step").distinct().collect()}


def load(store: Store, path: str, *, tick_size: float, symbol: str | None = None, source: str = "csv", strict: bool = True, step_rows: int = 5_000_000) -> dict:
    """Loads a file once. ``import_batches`` gets a row RUNNING and one COMPLETED or FAILED; ``import_blocks`` one for each step that is done.

    A file whose content is loaded already is skipped, whatever its name. A folder of files is loaded as one file, in the order of their names; only the first can have a header.
    """
    from .store import BATCH

    options = {"tick_size": tick_size, "symbol": symbol, "source": source, "strict": strict}
    spark, place = store.spark, source_of(store, path)
    head = _head(store, source=place)
    if head and store.state(head["fingerprint"]) == "COMPLETED":
        return {"state": "SKIPPED", "fingerprint": head["fingerprint"]}
    head = head or stage(store, path, place, step_rows, **options)
    mark = head["fingerprint"]
    if store.state(mark) == "COMPLETED":
        store._drop_staged(head["folder"])
        return {"state": "SKIPPED", "fingerprint": mark}
    batch, total = uuid.uuid4().hex, {"received": 0, "inserted": 0, "enriched": 0, "duplicates": 0}
    log = lambda state, n=None, message=None: store.record_batch(spark.createDataFrame([(batch, mark, path, state, *[(n or {}).get(k) for k in ("received", "inserted", "enriched")], message, now())], BATCH))
    log("RUNNING")
    try:
        layout, done = _layout(head["layout"]), done_steps(store, mark)
        for step in (k for k in range(head["steps"]) if k not in done):
            began = time.monotonic()
            trades = csv_trades.parsed(csv_trades.cells_of(step_lines(store, head, step), layout), layout, **options)
            rows = csv_trades.trades_or_error(csv_trades.in_sequence(trades, head["source_order"], head["first_row"], head["last_row"]))
            n = store.add_slice(rows, mark)
            total = {k: total[k] + n.get(k, 0) for k in total}
            row = (place, mark, step, n["received"], n["received"], n["inserted"], n.get("enriched", 0), time.monotonic() - began, now())
            store._write("import_blocks", spark.createDataFrame([row], BLOCK).coalesce(1), "append")
    except Exception as e:
        log("FAILED", message=str(e)[:500])
        raise
    log("COMPLETED", total)
    store._drop_staged(head["folder"])
    return {"state": "COMPLETED", "fingerprint": mark} | total


def progress(store: Store) -> DataFrame | None:
    """A row for each file: its state, the steps and rows that are done of all, and rows a second."""
    heads, blocks, batches = (store.read(t) for t in ("import_heads", "import_blocks", "import_batches"))
    if heads is None:
        return None
    c = F.col
    last = heads.groupBy("fingerprint").agg(*[F.max_by(k, "at").alias(k) for k in ("path", "steps", "rows")])
    if blocks is None:
        blocks = store.spark.createDataFrame([], BLOCK)
    # a step that was done twice counts once
    steps = blocks.groupBy("fingerprint", "step").agg(F.max_by(F.struct("received", "inserted", "enriched", "seconds"), "at").alias("x"))
    done = steps.groupBy("fingerprint").agg(F.count("*").alias("steps_done"), *[F.sum(f"x.{k}").alias(k) for k in ("received", "inserted", "enriched", "seconds")])
    out = last.join(done, "fingerprint", "left")
    if batches is not None:
        out = out.join(batches.groupBy("fingerprint").agg(F.max_by("state", "at").alias("state")), "fingerprint", "left")
    zero = {k: 0 for k in ("steps_done", "received", "inserted", "enriched")}
    return out.fillna(zero).withColumns({"share": c("steps_done") / c("steps"), "rows_per_second": F.when(c("seconds") > 0, c("received") / c("seconds"))})
