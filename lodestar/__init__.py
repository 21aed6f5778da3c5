"""Lodestar: a Spark-native engine for ranked lists, web pages and document corpora."""

__version__ = "0.1.0"
