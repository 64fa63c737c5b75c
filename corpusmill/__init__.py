"""Spark-native operators for curating text and speech corpora."""
