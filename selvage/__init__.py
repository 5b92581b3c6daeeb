"""Spark-native analytics for schema metadata and the document corpora behind it."""
