"""Spark-native processing of financial-report documents."""
