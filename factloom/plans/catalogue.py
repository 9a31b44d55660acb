"""All registered queries with their oracle SQL."""

from __future__ import annotations

from factloom.plans import documents, extraction, fields, graphs, lexemes, linking, metrics, records, review, scoring, sessions, truth  # noqa: F401  (they register their queries)
from factloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
