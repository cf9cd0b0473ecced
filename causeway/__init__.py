"""Spark-native analytics for fault trees, knowledge graphs and the logs around them."""
