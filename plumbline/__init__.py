"""plumbline: a PySpark-native engine for evaluating time-series forecasts under a frozen protocol."""
