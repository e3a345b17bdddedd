"""Small trade tables."""

from datetime import datetime, timedelta

from tickloom.schema import TRADES

T0 = datetime(2026, 10, 7, 10, 0)


def trades(spark, rows, start=T0, symbol="WINTEST", source="real"):
    """Rows (second, price, quantity, side, agent); side RLP is NONE with a flag."""
    out = []
    for n, (sec, price, qty, side, agent) in enumerate(rows, start=1):
        ts = start + timedelta(seconds=sec)
        rlp = side == "RLP"
        known = side if side in ("BUY", "SELL") else "NONE"
        out.append((symbol, ts, ts.date(), price, qty, str(n), known, source, agent if side == "BUY" else None, agent if side == "SELL" else None, n, "raw_aggressor=RLP" if rlp else None))
    return spark.createDataFrame(out, TRADES)


def priced(spark, prices, start=T0, symbol="WINTEST"):
    step = 58 / max(len(prices) - 1, 1)
    return trades(spark, [(k * step, p, 1, "BUY", "A") for k, p in enumerate(prices)], start, symbol)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]
