"""Spark-first corpus, tokenizer and evaluation engine."""

__version__ = "0.1.0"
