"""Spark-native analytics over biomedical evidence tables."""
