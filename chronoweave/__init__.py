"""Temporal graph analytics and corpus operators expressed with Spark DataFrames."""

__version__ = "0.1.0"
