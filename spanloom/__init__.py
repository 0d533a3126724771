"""Spark-native text annotation and span analytics."""
