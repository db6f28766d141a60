"""Spark-native discovery of hard-coded credentials in files and text columns."""

__version__ = "0.1.0"
