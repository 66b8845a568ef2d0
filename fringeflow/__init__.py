"""Spark-native analytics for radar-interferometry networks and their time series."""
