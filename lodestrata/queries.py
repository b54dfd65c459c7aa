"""Query id -> callable, and query id -> the same in SQL.

Each module of the package `lodestrata.checks` registers the queries of one family.
"""

from __future__ import annotations

from lodestrata.checks import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
