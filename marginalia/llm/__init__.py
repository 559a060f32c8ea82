"""Operators for large-scale text pipelines.

Nothing outside this package imports it; it can be removed without touching
the rest of the library.
"""
