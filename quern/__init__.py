"""Quern: a Spark-native engine for post-training data."""
