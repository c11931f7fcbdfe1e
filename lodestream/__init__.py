"""lodestream: a PySpark-native engine for documents and daily monitoring tables."""

__version__ = "0.1.0"
