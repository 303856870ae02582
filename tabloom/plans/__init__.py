"""Compositions of operators: end-to-end runs and the query registry."""
