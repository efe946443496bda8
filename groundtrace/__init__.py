"""Spark-native analytics for spotting abuse of built-in Windows tools in process-event logs."""

__version__ = "0.1.0"
