"""Aggregates, row functions and predicates as Spark column expressions."""
