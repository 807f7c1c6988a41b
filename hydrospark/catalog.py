"""All queries of the engine by name, with their SQL equivalents."""

from __future__ import annotations

from hydrospark.queries import hydraulic_queries, matching_queries, plan_queries, raster_queries, series_queries, terrain_queries

_MODULES = (series_queries, hydraulic_queries, raster_queries, matching_queries, terrain_queries, plan_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
