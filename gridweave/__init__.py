"""Multidimensional analytics on Spark DataFrames: a typed cube schema, a set algebra for axes, metric expressions."""
