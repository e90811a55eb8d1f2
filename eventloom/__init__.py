"""Spark-native analytics of event sequences and networks."""
