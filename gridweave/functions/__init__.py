"""Arithmetic on cells."""
