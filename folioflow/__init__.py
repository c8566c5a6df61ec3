"""Spark-native analytics for libraries of research documents."""
