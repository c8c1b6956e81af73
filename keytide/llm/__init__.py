"""Operators for training-data pipelines; nothing else in keytide imports this package."""
