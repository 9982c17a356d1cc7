"""Spark-native analytics over account ledgers."""
