"""Query name to callable, and to DuckDB SQL, for the reference's own operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from quire.plans.oracle_views import with_views

QUERIES: dict = {}
ORACLES: dict = {}
MODULES = ("text", "chunk", "usage", "metrics", "files", "intake", "tenancy", "vectors", "answers", "quotes", "quote_search", "report", "templates", "processors", "audit", "more")


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a callable (spark, sf_dir) -> DataFrame. The oracle may name derived views; their SQL goes before it."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = with_views(oracle)
        return f

    return put


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"quire.operators.{m}")
    importlib.import_module("quire.streaming.queries")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
