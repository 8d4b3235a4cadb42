"""Larkfield: a Spark-native engine for document corpora, retrieval and decision data."""

__version__ = "0.1.0"
