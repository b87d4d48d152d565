"""Spark-native analytics over tables of sequences and text."""
