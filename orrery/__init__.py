"""Spark-native analytics for sky catalogs, one-dimensional signals and training corpora."""
