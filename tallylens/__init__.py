"""Spark-native reconciliation and root-cause analytics."""

__version__ = "0.1.0"
