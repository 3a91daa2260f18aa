"""Spark-native typed-graph retrieval engine."""
