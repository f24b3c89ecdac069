"""Spark-first subword-tokenizer analytics."""

__version__ = "0.1.0"
