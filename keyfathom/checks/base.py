"""Collecting named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from keyfathom.checks.views import Inputs, with_views

Query = Callable[[Inputs], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` over the same views must give the same rows."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
