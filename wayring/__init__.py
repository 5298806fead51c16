"""Spark-native analytics for vehicle navigation telemetry."""
