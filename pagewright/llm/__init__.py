"""Operators for training-data pipelines over web text. Nothing outside this package imports it."""
