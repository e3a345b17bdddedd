"""Table functions for SQL: waves and pressure windows of a candle by ``PARTITION BY`` and ``ORDER BY``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

NEEDED = ("symbol", "start", "buy", "sell", "signed_dominance", "coverage")
#: Built here, as there is no session where a call is analyzed.
WAVE = StructType()
for _name, _type in zip("symbol start wave side start_idx peak_idx peak_qty peak_dominance end_idx termination last_idx".split(), (StringType, LongType, IntegerType, StringType, LongType, LongType, LongType, DoubleType, LongType, StringType, LongType)):
    WAVE.add(_name, _type())


class WavesOf:
    """Waves of one candle's pressure windows, which come in order. The call names the partition and the order:

    SELECT * FROM waves_of(TABLE(pressure) PARTITION BY (symbol, start) ORDER BY idx, window_trades => 25)
    """

    def __init__(self, *_):
        from ..operators.waves import WaveRules, WaveState

        self.rules, self.state_of = WaveRules, WaveState
        self.state, self.n, self.wave, self.key = None, 0, 0, None

    @staticmethod
    def analyze(pressure: AnalyzeArgument, window_trades: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not pressure.isTable:
            raise ValueError("waves_of takes a table of pressure windows")
        missing = [c for c in NEEDED if c not in pressure.dataType.fieldNames()]
        if missing:
            raise ValueError(f"the table has no {', '.join(missing)}")
        if window_trades is not None and (not window_trades.isConstantExpression or (window_trades.value or 0) < 1):
            raise ValueError("window_trades must be a positive constant")
        return AnalyzeResult(WAVE)

    def eval(self, row: Row, window_trades: int = 25) -> Iterator[tuple]:
        if self.state is None:
            self.state, self.key = self.state_of(self.rules(window=window_trades)), (row["symbol"], row["start"])
        found = self.state.step(self.n, row["buy"], row["sell"], row["signed_dominance"], row["coverage"])
        if found:
            yield self._row(found)
            self.wave += 1
        self.n += 1

    def terminate(self) -> Iterator[tuple]:
        """The wave that is open at the candle's end."""
        if self.state is not None and self.state.side:
            yield self._row(self.state.wave())

    def _row(self, found: dict) -> tuple:
        return (*self.key, self.wave, *(found.get(k) for k in ("side", "start_idx", "peak_idx", "peak_qty", "peak_dominance", "end_idx", "termination")), self.n - ("termination" not in found))


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    spark.udtf.register("waves_of", udtf(WavesOf))
