"""Every query of the core library by name."""

from __future__ import annotations

from treeloom.plans import data_queries, graph_queries, retrieval_queries, store_queries

_MODULES = [data_queries, graph_queries, retrieval_queries, store_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}


def flagship(spark, sf_dir):
    return queries()["context_items"](spark, sf_dir)
