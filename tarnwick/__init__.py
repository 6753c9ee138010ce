"""Spark-native analytics engine for directories of people and collections of documents."""
