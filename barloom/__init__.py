"""Spark-native analytics over OHLCV price bars."""

__version__ = "0.1.0"
