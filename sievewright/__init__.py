"""Spark-first engine for building, auditing and comparing evaluation data."""

__version__ = "0.1.0"
