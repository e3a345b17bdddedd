"""Aggression waves: rolling pressure windows in Spark, and a small causal state machine for each candle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..schema import CANDLE, in_candle, indexed, ratio


@dataclass(frozen=True)
class WaveRules:
    window: int = 25
    activate: float = 0.55
    release: float = 0.20
    takeover: float = 0.45
    coverage: float = 0.50
    confirm_start: int = 2
    confirm_end: int = 3
    decay: float = 0.35
    horizon: int = 50
    reversal_ticks: int = 2


RULES = WaveRules()


def pressure_window(trades: DataFrame, interval: int, window: int = RULES.window) -> DataFrame:
    """For each trade, the flow of the last ``window`` trades of its candle."""
    w = in_candle().rowsBetween(1 - window, 0)
    q = lambda s: F.sum(F.when(F.col("aggressor") == s, F.col("quantity")).otherwise(0)).over(w)
    t = indexed(trades, interval).withColumns({"buy": q("BUY"), "sell": q("SELL"), "total": F.sum("quantity").over(w)})
    directed = F.col("buy") + F.col("sell")
    return t.withColumns({"directed": directed, "signed_dominance": ratio(F.col("buy") - F.col("sell"), directed), "coverage": ratio(directed, F.col("total"))})


class WaveState:
    """One candle's detector. It sees each window once, in order, and never looks ahead."""

    def __init__(self, rules: WaveRules = RULES, state: dict | None = None):
        self.rules = rules
        self.side = self.ending = self.leaning = None
        self.start = self.peak_at = self.run = self.first = 0
        self.peak_qty, self.peak_dominance = 0, 0.0
        self.__dict__.update(state or {})

    def saved(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rules"}

    def _lean(self, i: int, buy: int, sell: int, dominance: float, covered: bool) -> None:
        r = self.rules
        side = ("BUY" if dominance >= r.activate else "SELL" if dominance <= -r.activate else None) if covered else None
        if side is None or side != self.leaning:
            self.leaning, self.run, self.first = side, 0, i
        self.run += side is not None
        if side and self.run >= r.confirm_start:
            self.side, self.start, self.peak_at = side, self.first, i
            self.peak_qty, self.peak_dominance = (buy, dominance) if side == "BUY" else (sell, -dominance)
            self.leaning, self.ending, self.run = None, None, 0

    def step(self, i: int, buy: int, sell: int, dominance: float, coverage: float) -> dict | None:
        """Takes the window that ends at trade ``i``; gives the wave that it ends, if any."""
        r = self.rules
        if i + 1 < r.window:
            return None
        covered = coverage >= r.coverage
        if self.side is None:
            self._lean(i, buy, sell, dominance, covered)
            return None
        qty, other = (buy, sell) if self.side == "BUY" else (sell, buy)
        same = dominance if self.side == "BUY" else -dominance
        if qty > self.peak_qty:
            self.peak_qty, self.peak_at = qty, i
        self.peak_dominance = max(self.peak_dominance, same)
        peak = max(self.peak_qty, 1)
        kind = None
        if covered and -same >= r.takeover:
            kind = "TROCA_CONTROLE"
        elif same <= r.release:
            kind = "EXAUSTAO" if qty / peak <= r.decay else "NEUTRALIZACAO"
        self.run = 0 if kind is None else self.run + 1 if kind == self.ending else 1
        self.ending = kind
        if kind is None or self.run < r.confirm_end:
            return None
        wave = self.wave() | {"end_idx": i, "termination": kind, "end_side_qty": qty, "end_opposite_qty": other, "end_coverage": coverage, "end_dominance": dominance, "pressure_decay": 1.0 - min(qty / peak, 1.0)}
        self.side = self.ending = self.leaning = None
        self.run = 0
        return wave

    def wave(self) -> dict:
        return {"side": self.side, "start_idx": self.start, "peak_idx": self.peak_at, "peak_qty": self.peak_qty, "peak_dominance": self.peak_dominance}


WAVE_SCHEMA = (
    "symbol string, start long, wave int, side string, start_idx long, peak_idx long, peak_qty long, peak_dominance double, end_idx long, termination string, "
    "end_side_qty long, end_opposite_qty long, end_coverage double, end_dominance double, pressure_decay double, end_price long, last_idx long"
)


def _detect(rules: dict):
    schema = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[t]) for c, t in (x.split() for x in WAVE_SCHEMA.split(", "))])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partitions are sorted by candle and place, so that a candle's rows come in a row; only the state is held."""
        key, state, n, last = None, WaveState(WaveRules(**rules)), 0, -1

        def left():
            return [dict(zip(("symbol", "start"), key), wave=n, last_idx=last) | state.wave()] if key and state.side else []

        for batch in batches:
            out = []
            for symbol, start, i, price, buy, sell, dominance, coverage in zip(*(c.to_pylist() for c in batch.columns)):
                if (symbol, start) != key:
                    out += left()
                    key, state, n = (symbol, start), WaveState(WaveRules(**rules)), 0
                last = i
                wave = state.step(i, buy, sell, dominance, coverage)
                if wave:
                    out.append({"symbol": symbol, "start": start, "wave": n, "last_idx": i, "end_price": price} | wave)
                    n += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if found := left():
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return f


def all_waves(trades: DataFrame, interval: int, rules: WaveRules = RULES) -> DataFrame:
    """Waves that ended (``end_idx`` set) and the one still open at a candle's end, if any."""
    windows = pressure_window(trades, interval, rules.window).select(*CANDLE, "idx", "price_ticks", "buy", "sell", "signed_dominance", "coverage")
    # the windows' shuffle already brought candles together: this sort needs no other
    return windows.sortWithinPartitions(*CANDLE, "idx").mapInArrow(_detect(asdict(rules)), WAVE_SCHEMA)


def waves(trades: DataFrame, interval: int, rules: WaveRules = RULES) -> DataFrame:
    return all_waves(trades, interval, rules).filter("end_idx IS NOT NULL").drop("last_idx")


def open_waves(trades: DataFrame, interval: int, rules: WaveRules = RULES) -> DataFrame:
    return all_waves(trades, interval, rules).filter("end_idx IS NULL").select(*CANDLE, "wave", "side", "start_idx", "peak_qty", "peak_dominance", "last_idx", F.lit("ABERTA_NO_FIM_DO_CANDLE").alias("status"))


def wave_post_event(trades: DataFrame, interval: int, rules: WaveRules = RULES) -> DataFrame:
    """What prices did in the trades after each wave's end. It looks ahead, for validation only.

    Each ended wave is joined with the places that follow its end, so only these trades are read further, not a window for every trade.
    """
    c = F.col
    t = indexed(trades, interval)
    found = waves(t, interval, rules).select(*CANDLE, "wave", "side", "termination", "end_idx", "end_price")
    after = found.withColumn("idx", F.explode(F.sequence(c("end_idx") + 1, c("end_idx") + rules.horizon)))
    x = found.join(after.select(*CANDLE, "wave", "idx").join(t.select(*CANDLE, "idx", "price_ticks"), [*CANDLE, "idx"]), [*CANDLE, "wave"], "left")
    away = F.when(c("side") == "BUY", c("end_price") - c("price_ticks")).otherwise(c("price_ticks") - c("end_price"))  # positive: the price turned
    g = x.groupBy(*CANDLE, "wave").agg(
        *[F.first(k).alias(k) for k in ("side", "termination", "end_idx")],
        F.count("price_ticks").alias("observations"),
        F.greatest(F.lit(0), F.coalesce(F.max(away), F.lit(0))).alias("max_reversal_ticks"),
        F.greatest(F.lit(0), F.coalesce(F.max(-away), F.lit(0))).alias("max_continuation_ticks"),
        F.min(F.when(away >= rules.reversal_ticks, c("idx") - c("end_idx"))).alias("first_reversal_offset"),
    )
    r, k = c("max_reversal_ticks"), c("max_continuation_ticks")
    outcome = F.when(c("observations") == 0, "SEM_JANELA_POSTERIOR").when((r >= rules.reversal_ticks) & (r > k), "REVERSAO_COMPATIVEL").when((k >= rules.reversal_ticks) & (k > r), "CONTINUACAO").otherwise("ESTAGNACAO_OU_DISPUTA")
    return g.withColumn("outcome", outcome)


def wave_agents(trades: DataFrame, interval: int, rules: WaveRules = RULES, limit: int = 5) -> DataFrame:
    """The largest agents of each wave's side, from its start to its end. A candle's waves don't overlap, so each trade takes the
    last wave that started before it: waves are joined with the trades that start them, not with all of their candle."""
    t = indexed(trades, interval)
    mark = F.struct("wave", F.col("side").alias("wave_side"), F.coalesce("end_idx", "last_idx").alias("to_idx")).alias("mark")
    starts = all_waves(t, interval, rules).select(*CANDLE, F.col("start_idx").alias("idx"), mark)
    t = t.join(starts, [*CANDLE, "idx"], "left").withColumn("mark", F.last("mark", ignorenulls=True).over(in_candle().rowsBetween(Window.unboundedPreceding, 0)))
    t = t.filter("idx <= mark.to_idx AND aggressor = mark.wave_side").select(*CANDLE, "mark.wave", F.col("mark.wave_side").alias("side"), "buyer_id", "seller_id", "quantity")
    agent = F.trim(F.coalesce(F.when(F.col("side") == "BUY", F.col("buyer_id")).otherwise(F.col("seller_id")), F.lit("")))
    g = t.groupBy(*CANDLE, "wave", "side", agent.alias("agent")).agg(F.sum("quantity").alias("quantity"), F.count("*").alias("trades"))
    one = Window.partitionBy(*CANDLE, "wave")
    g = g.withColumn("share", F.col("quantity") / F.sum("quantity").over(one)).filter("agent <> ''")
    return g.withColumn("rank", F.row_number().over(one.orderBy(F.desc("quantity"), "agent"))).filter(F.col("rank") <= limit)
