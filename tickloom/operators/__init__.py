"""DataFrame-to-DataFrame operators over trades and candles."""
