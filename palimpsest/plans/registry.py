"""All registered queries with their paired DuckDB SQL."""

from __future__ import annotations

import importlib

from palimpsest.plans import base

MODULES = ["series_queries", "store_queries", "vintage_queries", "model_queries", "source_queries", "sink_queries", "search_queries", "metadata_queries", "build_queries"]


def _loaded():
    for m in MODULES:
        importlib.import_module(f"palimpsest.plans.{m}")
    return base


def queries() -> dict:
    return dict(_loaded().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_loaded().SQL)
