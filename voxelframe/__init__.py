"""Spark-native features for gridded measurements and the tables derived from them."""
