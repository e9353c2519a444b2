"""Operators for training-data pipelines; see README.md of the repository."""
