"""Registered queries over the test tables, with their SQL."""

from . import wider  # noqa: F401  adds its queries to the same tables
from .queries import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
