"""Spark-native engine for literature mining: text to graph, search, ranking and evaluation."""
