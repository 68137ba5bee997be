"""Spark-native evaluation of gridded physical models against observed labels."""
