"""Spark-native learning-content engine: DataFrame operators, quality rules, streams and plans."""
