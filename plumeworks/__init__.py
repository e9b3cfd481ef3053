"""Spark-native analytics for mobile sensor measurements and their urban context."""
