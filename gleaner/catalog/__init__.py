"""Registered queries: each runs a library function over the given tables, with its oracle SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "functions_queries", "predicate_queries", "source_queries", "join_queries",
    "aggregate_queries", "sequence_queries", "document_queries", "ledger_queries",
    "stream_queries",
)


def load() -> tuple[dict, dict]:
    """Import every module once and return ``(queries, oracles)``."""
    from gleaner.catalog.registry import ORACLES, QUERIES

    for name in _MODULES:
        import_module(f"gleaner.catalog.{name}")
    return QUERIES, ORACLES
