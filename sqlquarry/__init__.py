"""Spark-native mining and analysis of SQL corpora."""
