"""Marlstone: exact analytics over immutable Parquet segments, on Spark."""

__version__ = "0.1.0"
