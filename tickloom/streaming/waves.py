"""Aggression waves over streams, by typed state and timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.waves import RULES, WaveRules, WaveState
from ..schema import CANDLE, LAST

OUT = "symbol string, start long, wave int, side string, start_idx long, peak_idx long, peak_qty long, peak_dominance double, end_idx long, termination string, last_idx long, status string"
NAMES = [c.split()[0] for c in OUT.split(", ")]
PENDING = "us long, sequence_no long, trade_id string, quantity long, aggressor string"
WINDOW = "quantity long, aggressor string"
DETECTOR = "n long, wave int, side string, ending string, leaning string, start long, peak_at long, run long, first long, peak_qty long, peak_dominance double"
HELD = ["side", "ending", "leaning", "start", "peak_at", "run", "first", "peak_qty", "peak_dominance"]
OPEN = "ABERTA_NO_FIM_DO_CANDLE"


def _place(row) -> tuple:
    """The canonical order of trades."""
    us, sequence, trade_id = row[:3]
    number = int(trade_id) if trade_id is not None and trade_id.lstrip("+-").isdigit() else None
    return us, LAST if sequence is None else sequence, number is None, number or 0, trade_id or ""


class Waves(StatefulProcessor):
    """One candle. Trades wait until the watermark has passed them and are then taken in canonical order, so their order of arrival doesn't matter; at the
    candle's end a timer takes the rest, gives the wave that is still open, and clears the state. Held are the trades of the lateness that is waited for,
    the last window and the detector."""

    def __init__(self, interval: int, rules: WaveRules):
        self.interval, self.rules = interval, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING)
        self.window = handle.getListState("window", WINDOW)
        self.detector = handle.getValueState("detector", DETECTOR)

    def _restored(self) -> tuple[int, int, WaveState]:
        if not self.detector.exists():
            return 0, 0, WaveState(self.rules)
        n, wave, *held = self.detector.get()
        return int(n), int(wave), WaveState(self.rules, {k: v if v is None or isinstance(v, (str, float)) else int(v) for k, v in zip(HELD, held)})

    def _take(self, key, rows: list[tuple], last: bool) -> list[dict]:
        n, count, state = self._restored()
        window = [(int(q), s) for q, s in self.window.get()] if n else []
        found = []
        for *_, quantity, side in sorted(rows, key=_place):
            window = [*window, (int(quantity), side)][-self.rules.window :]
            buy, sell = (sum(q for q, s in window if s == x) for x in ("BUY", "SELL"))
            directed, total = buy + sell, sum(q for q, _ in window)
            wave = state.step(n, buy, sell, (buy - sell) / directed if directed else 0.0, directed / total if total else 0.0)
            if wave:
                found.append(wave | {"wave": count, "last_idx": n})
                count += 1
            n += 1
        if last:
            if state.side:
                found.append(state.wave() | {"wave": count, "last_idx": n - 1, "status": OPEN})
        elif rows:
            self.window.put(window)
            self.detector.update((n, count, *(state.saved()[k] for k in HELD)))
        return [{"symbol": key[0], "start": int(key[1])} | w for w in found]

    @staticmethod
    def _frame(found: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([[w.get(c) for c in NAMES] for w in found], columns=NAMES, dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PENDING.split(", ")]
        new = [tuple(None if pd.isna(x) else x for x in r) for frame in rows for r in frame[names].itertuples(index=False)]
        held = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        until = timerValues.getCurrentWatermarkInMs() * 1000
        ready = [r for r in [*held, *new] if r[0] < until]
        wait = [r for r in [*held, *new] if r[0] >= until]
        if ready or not held:
            self.pending.put([_plain(r) for r in wait]) if wait else self.pending.clear()
        else:
            self.pending.appendList([_plain(r) for r in new])
        end = (int(key[1]) + self.interval) * 1000
        if end not in list(self.handle.listTimers()):
            self.handle.registerTimer(end)
        yield self._frame(self._take(key, ready, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        found = self._take(key, rows, True)
        for state in (self.pending, self.window, self.detector):
            state.clear()
        yield self._frame(found)

    def close(self) -> None:
        pass


def _plain(row: tuple) -> tuple:
    us, sequence, trade_id, quantity, side = row
    return int(us), None if sequence is None else int(sequence), trade_id, int(quantity), side


def streaming_waves(trades: DataFrame, interval: int, rules: WaveRules = RULES, late: str = "5 minutes") -> DataFrame:
    """Ended waves once the watermark has passed their end, and with ``status`` the wave that is open at its candle's end. Needs the RocksDB state store."""
    t = trades.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late).withColumn("us", F.unix_micros("event_time"))
    t = t.withColumn("start", (F.floor(F.floor(F.col("us") / 1_000_000) / interval) * interval).cast("long"))
    return t.groupBy(*CANDLE).transformWithStateInPandas(Waves(interval, rules), OUT, "Append", "EventTime")
