"""All queries of the library itself, with the SQL of those that SQL can express."""

from __future__ import annotations

from strataflow.plans import queries_aggregates, queries_alignment, queries_lookup, queries_models, queries_ordered, queries_sources

_MODULES = (queries_ordered, queries_aggregates, queries_lookup, queries_alignment, queries_models, queries_sources)
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
