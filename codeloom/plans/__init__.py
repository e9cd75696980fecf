"""Registered queries of the core operators and their SQL oracles."""

from __future__ import annotations


def _load():
    from codeloom.plans import graph_queries, metric_queries, note_queries, search_queries, source_queries, vector_queries  # noqa: F401
    from codeloom.plans import registry

    return registry


def core_queries() -> dict:
    return dict(_load().QUERIES)


def core_oracles() -> dict:
    return dict(_load().ORACLES)
