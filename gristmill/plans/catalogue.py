"""All queries of the library by name, with their SQL twins for DuckDB."""

from __future__ import annotations

from gristmill.plans import aggregate_queries, decision_queries, feature_queries, intelligence_queries, learning_queries, metric_queries, source_queries, streaming_queries

_MODULES = (source_queries, feature_queries, aggregate_queries, metric_queries, decision_queries, intelligence_queries, streaming_queries, learning_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
