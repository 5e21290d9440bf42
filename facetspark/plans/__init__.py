"""Registered queries over the relational tables, with the SQL each is checked against."""

from __future__ import annotations

from .registry import ORACLE, QUERIES
from . import characters, facets, feeds, graphs, people, recommending, rows, scalars, search, signals, streams, vectors  # noqa: E402, F401

FLAGSHIP = "a1_facet_counts"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
