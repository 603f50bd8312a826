"""Spark-native analytics over web-page corpora."""
