"""Heap-dump analytics and record-quality operators on Spark DataFrames."""

__version__ = "0.1.0"
