"""Spark-native analytics for head-to-head combat-sports data."""
