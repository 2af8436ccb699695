"""All queries of the core library with the SQL each is compared with."""

from __future__ import annotations

from vidsift.plans import evidence_queries, frame_queries, relational_queries, review_queries, sequence_queries, text_queries, vector_queries
from vidsift.registry import Query

MODULES = (vector_queries, text_queries, evidence_queries, sequence_queries, frame_queries, relational_queries, review_queries)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.registry.sql.items()}
