"""Spark-native rescoring of scored candidate matches, error-rate control and protein inference."""
