"""Registered queries over the driver's tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "hourly_well_summary"
MODULES = ("physics_queries", "window_queries", "join_queries", "report_queries", "kernel_queries", "reading_queries", "history_queries", "hourly_queries", "advisory_queries", "store_queries", "text_queries")


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL where SQL can express it."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"mudline.plans.{name}")
