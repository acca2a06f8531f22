"""Spark-native private joins: noisy sketches, private features and corrected models as lazy DataFrames."""
