"""Spark-native analytics over large archives of short, timestamped posts."""
