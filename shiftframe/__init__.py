"""Spark-native analytics over event logs and time intervals."""
