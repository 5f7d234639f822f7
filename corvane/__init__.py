"""Corvane: governed facts, hybrid retrieval and operational analytics on Spark DataFrames."""

__version__ = "0.1.0"
