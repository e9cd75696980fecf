"""Spark-native code-intelligence analytics: property graph, text search, vectors, metrics, history and memory as DataFrames."""

__version__ = "0.1.0"
