"""All pN_ queries; importing the problem modules registers them."""

from __future__ import annotations

import importlib

from codestrata.llm import registry

MODULES = ("fusion", "docpairs", "frequency", "provenance", "cooccurrence", "syntax", "tokens", "leakage", "spans")

for _m in MODULES:
    importlib.import_module(f"codestrata.llm.{_m}")


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.ORACLES)
