"""Fact tables: files, derived level columns, and the star schema of the test tables."""
