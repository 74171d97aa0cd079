"""Lamina: Spark-native analytics for layered recorded-media data."""
