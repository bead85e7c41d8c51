"""The registered queries and their SQL."""

from __future__ import annotations

from . import gate_queries, geometry_queries, motion_queries, recording_queries, relational_queries, series_queries

_MODULES = (series_queries, relational_queries, geometry_queries, gate_queries, recording_queries, motion_queries)
QUERIES: dict = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
