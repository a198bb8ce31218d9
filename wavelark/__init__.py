"""Spark-native analytics over radio-sensor telemetry."""
