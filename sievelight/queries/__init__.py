"""Queries over the driver's tables for each operator family, and their SQL."""

from __future__ import annotations

from . import intake, learning, limits, modules, scripts, streams, surface, telemetry

FLAGSHIP = "module_scorecard"
_FAMILIES = (modules, scripts, telemetry, intake, learning, surface, streams, limits)
QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL = {name: sql for family in _FAMILIES for name, sql in family.ORACLE_SQL.items()}
