"""Readers for delimited files and the test tables, and the writers."""
