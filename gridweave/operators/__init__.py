"""Measure aggregation by grain, metric arithmetic and the set algebra."""
