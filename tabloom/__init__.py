"""Tabular analytics and panel forecasting as Spark jobs.

Every operator takes and returns DataFrames.  Decisions that need numbers (which
target, which features, which branch) are taken from small aggregated tables; row
data never passes through the driver.
"""
