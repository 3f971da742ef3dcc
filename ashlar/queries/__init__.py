"""Registered queries with their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text", "routing", "conversation", "retrieval", "structure", "tables", "ingest", "assembly", "pages", "runs")


def load() -> None:
    """Imports every query module, which registers its queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
