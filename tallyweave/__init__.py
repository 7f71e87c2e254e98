"""Spark-native engine for noisy form readings and the records built from them."""
