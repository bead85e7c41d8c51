"""A PySpark-native engine for sensor telemetry and training data."""
