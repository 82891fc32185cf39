"""All queries of the span engine by name, and their SQL."""

from __future__ import annotations

from .plans import curation, exchange, labels, reports, runs, scoring, spans, training

_MODULES = (spans, scoring, curation, training, exchange, runs, labels, reports)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
