"""Operators for large training corpora. Nothing outside this subpackage imports it."""

from .catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
