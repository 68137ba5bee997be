"""Operators for training-data pipelines over the document tables."""
