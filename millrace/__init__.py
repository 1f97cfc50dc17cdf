"""Declarative data pipelines over ordered record streams, on Spark DataFrames."""

__version__ = "0.1.0"
