"""Spark-native analytics engine for financial time series."""
