"""Hierarchical document analytics on Spark: trees of text chunks, spans, vectors and graphs as DataFrames."""

__version__ = "0.1.0"
