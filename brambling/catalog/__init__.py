"""Registered queries over the test tables, and their DuckDB equivalents."""

from __future__ import annotations

from . import collections, grouping, joins, pages, scalars, search, storage
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "collections", "grouping", "joins", "pages", "scalars", "search", "storage"]
