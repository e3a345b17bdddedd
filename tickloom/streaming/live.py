"""Live ingest: trades go to the store and candles are written once they are closed; trades that come later are put aside and absorbed.

Each micro-batch moves a watermark: the latest time seen, less the lateness that is waited for. A candle is closed when the watermark has
passed its end, and is then built from the stored trades. A trade whose candle is closed already goes to the quarantine. ``absorb`` adds
the quarantine to the trades and recomputes the candles of its symbols and days. All state is in tables: marks by batch number, so that a batch that is run again
after a failure finds the watermark that it found before, and adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.candles import build_candles
from ..operators.research import with_session
from ..schema import micros, with_start
from ..sources.store import Store, trade_key

MARK = "batch long, watermark long"
KEY = ["interval_seconds", "symbol", "start"]


def watermark(store: Store, before: int | None = None) -> int | None:
    """Microseconds up to which candles are closed: as the batches before ``before`` left it, or as it stands."""
    marks = store.read("live_marks")
    if marks is None:
        return None
    return (marks if before is None else marks.filter(F.col("batch") < before)).agg(F.max("watermark")).first()[0]


def _key(of: DataFrame) -> DataFrame:
    return of.withColumn("candle_key", F.concat_ws("|", *KEY))


def closed(store: Store, interval: int, after: int | None, until: int) -> DataFrame:
    """Candles whose end is in (after, until], from the stored trades. Only days that such candles can be on are read."""
    stored, end = store.read("trades"), (F.col("start") + interval) * 1_000_000
    t = stored.withColumn("us", micros(stored)).filter(F.col("us") < until)
    if after is not None:
        first = after - interval * 1_000_000
        t = t.filter((F.col("us") >= first) & (F.col("session_date") >= _date(first)))
    found = build_candles(t.filter(F.col("session_date") <= _date(until)), interval).filter(end <= until)
    return with_session(found if after is None else found.filter(end > after)).withColumn("interval_seconds", F.lit(interval))


def _date(us: int) -> Column:
    """The wall-clock day of microseconds since the epoch."""
    return F.date_add(F.lit("1970-01-01").cast("date"), int(us // 86_400_000_000))


def _take(store: Store, rows: DataFrame, batch: int, interval: int, late_us: int) -> dict[str, int]:
    before = watermark(store, batch)
    us = micros(rows)
    staged, path, n = store._staged_and_counted(rows.withColumn("event_key", trade_key()), received=F.count("*"), high=F.max(us))
    if not n["received"]:
        store._drop_staged(path)
        return {"received": 0, "late": 0, "candles": 0}
    end = (F.col("start") + interval) * 1_000_000
    is_late = F.lit(False) if before is None else end <= before
    t = with_start(staged, interval)
    late = store.add("quarantine", t.filter(is_late), "event_key")["received"]
    store.add("trades", t.filter(~is_late), "event_key")
    mark = n["high"] - late_us if before is None else max(before, n["high"] - late_us)
    made = 0
    if before is None or mark > before:
        made = store.add("live_candles", _key(closed(store, interval, before, mark)), "candle_key")["inserted"]
    # last, so a batch that broke off finds the same watermark again
    store._write("live_marks", store.spark.createDataFrame([(batch, mark)], MARK).coalesce(1), "append")
    store._drop_staged(path)
    return {"received": n["received"], "late": late, "candles": made}


def live(stream: DataFrame, store: Store, checkpoint: str, interval: int, late_seconds: int = 300, progress=None):
    """Starts the query. ``progress`` is called with each batch's number and counts."""

    def take(rows: DataFrame, batch: int) -> None:
        n = _take(store, rows, batch, interval, late_seconds * 1_000_000)
        if progress:
            progress(batch, n)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def absorb(store: Store, interval: int) -> dict[str, int]:
    """Adds the quarantined trades, recomputes the closed candles of their symbols and days, and empties the quarantine. Broken off, it is done again."""
    aside, mark = store.read("quarantine"), watermark(store)
    if aside is None or mark is None or aside.isEmpty():
        return {"late": 0, "days": 0}
    days, path = store._staged(aside.select("symbol", "session_date").distinct())
    n = store.add("trades", aside, "event_key")
    trades = store.partitions_of("trades", days)
    made = build_candles(trades, interval).filter((F.col("start") + interval) * 1_000_000 <= mark)
    store._write("live_candles", _key(with_session(made).withColumn("interval_seconds", F.lit(interval))), "overwrite")
    held = days.collect()  # symbols and days that had late trades
    for r in held:
        store._remove_partition("quarantine", symbol=r["symbol"], session_date=r["session_date"])
    store._drop_staged(path)
    return {"late": n["received"], "days": len(held)}


def close(store: Store, interval: int) -> int:
    """Ends the stream's last candles: the watermark goes past the latest trade's candle. The number of candles written."""
    before = watermark(store)
    if before is None:
        return 0
    high = with_start(store.read("trades"), interval).agg(F.max("start")).first()[0]
    mark = max(before, (high + interval) * 1_000_000)
    made = store.add("live_candles", _key(closed(store, interval, before, mark)), "candle_key")["inserted"]
    last = store.read("live_marks").agg(F.max("batch")).first()[0]
    store._write("live_marks", store.spark.createDataFrame([(last, mark)], MARK).coalesce(1), "append")
    return made
