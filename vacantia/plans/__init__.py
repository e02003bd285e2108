"""Registered queries, grouped by subject."""

from __future__ import annotations

MODULES = ["addresses", "record_queries", "text_queries", "scoring_queries", "link_queries", "join_queries",
           "summary_queries", "window_queries", "export_queries", "stream_queries", "flagship"]


def load() -> dict:
    """All registered queries by name."""
    from importlib import import_module, util

    from .registry import REGISTRY

    for name in MODULES:
        if util.find_spec(f"{__name__}.{name}"):
            import_module(f"{__name__}.{name}")
    return REGISTRY
