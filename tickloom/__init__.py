"""Spark-native analytics for trade-by-trade market microstructure."""
