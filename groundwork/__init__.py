"""Permutation-native analytics on Spark."""
