"""Spark-native analytics over general-ledger audit files."""

__version__ = "0.1.0"
