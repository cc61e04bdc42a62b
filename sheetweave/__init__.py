"""Spark-native document-structure analytics: workbooks, cells, Markdown chunks, nested records and text tables."""

__version__ = "0.1.0"
