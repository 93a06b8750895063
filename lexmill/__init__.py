"""Spark-native lexical search and relevance analytics."""
