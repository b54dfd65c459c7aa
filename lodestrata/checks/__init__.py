"""Queries over the driver's tables, one module for each family of operators."""

from lodestrata.checks import changes, gates, graph, project, scalar, sources, streams, structure, telemetry, text, tools  # noqa: F401
from lodestrata.checks.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
