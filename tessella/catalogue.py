"""Every query of the engine by name, with its SQL twin."""

from __future__ import annotations

from .plans import blocks, catalog, chunking, composed, graph, hybrid, knowledge, language, readers, retrieval, scalars, store  # noqa: F401  (each registers its queries)
from .plans.registry import QUERIES, SQL
from .streaming import queries as streams  # noqa: F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
