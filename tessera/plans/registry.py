"""Every registered query of the engine with its DuckDB oracle, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from ..shipping import ship

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``f(spark, sf_dir)``; without ``sql`` the query is checked by tests instead."""

    def add(f):
        @wraps(f)
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    from . import detection, embedding, evaluation, graphs, linking, patterns, texts, walking  # noqa: F401  each registers its queries


_load()
