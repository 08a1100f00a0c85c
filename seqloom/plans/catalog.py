"""All core queries and their SQL."""

from __future__ import annotations

from . import document_queries, hit_queries, numbering_queries, result_queries, sequence_queries

MODULES = [document_queries, sequence_queries, hit_queries, numbering_queries, result_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark, sf_dir):
    """Every record searched, numbered and assigned its genes."""
    return hit_queries.number_sequences(spark, sf_dir)
