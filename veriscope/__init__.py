"""Spark-native checking of statements against evidence, at table scale."""
