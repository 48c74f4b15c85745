"""Spark-native measurement of retrieval-backed question answering systems."""
