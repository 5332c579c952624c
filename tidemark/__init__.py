"""Spark-native curation and discovery analytics."""
