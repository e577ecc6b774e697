"""The query catalogue of the engine's own operators."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}

MODULES = ("call_queries", "index_queries", "text_queries", "extract_queries")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its DuckDB equivalent."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _all() -> None:
    for m in MODULES:
        importlib.import_module(f"codestrata.plans.{m}")


def queries() -> dict:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _all()
    return dict(ORACLES)
