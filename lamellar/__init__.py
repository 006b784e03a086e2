"""Spark-native analytics for labelled 3-D volumes, skeleton graphs and text corpora."""
