"""Scalar functions on cells, and wrappers of result rows."""
