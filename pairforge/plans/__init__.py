"""Registered queries: each pairs a Spark plan with the DuckDB statement that must give the same rows."""

from __future__ import annotations

import importlib

MODULES = ("vectors", "curate", "sampling", "batching", "evaluate", "files", "streams", "models", "jobs")


def load() -> None:
    """Imports every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
