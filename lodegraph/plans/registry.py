"""Every registered query of the code-graph engine with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from ..sources import adapters

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, with_: str = ""):
    """Register a query; its SQL stands after the canonical tables and `with_`."""

    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = f"WITH RECURSIVE {adapters.SQL}{', ' + with_ if with_ else ''}\n{sql}"
        return fn

    return register


def _load() -> None:
    from . import extract_queries, graph_queries, symbol_queries, text_queries, time_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)


def FLAGSHIP(spark, sf):  # noqa: N802
    return queries()["f5_dedup"](spark, sf)
