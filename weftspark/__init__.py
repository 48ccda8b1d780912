"""Spark-native operators for multilingual document collections."""
