"""Spark-native analytics over versioned discussion data."""
