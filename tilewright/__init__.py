"""Tilewright: a Spark-native engine for sequence tiling, interval and corpus work."""
