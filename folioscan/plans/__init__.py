"""Query plans of the engine."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """All registered queries and their SQL."""
    from . import ask_queries, mention_queries, registry, report_queries, search_queries, service_queries, text_queries  # noqa: F401

    return registry.QUERIES, registry.SQL
