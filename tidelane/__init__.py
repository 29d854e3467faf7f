"""Spark-native analytics for ordered event and candle data."""
