"""Predicates, comparison rules and aggregates as column expressions."""
