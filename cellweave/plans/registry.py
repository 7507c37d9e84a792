"""Registration of queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(body: str | None = None, ctes: str = "", *, raw: bool = False) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle: a body over the views, or whole SQL if ``raw``."""

    def add(fn: Query) -> Query:
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if body is not None:
            SQL[name] = body if raw else oracle(body, ctes)
        return fn

    return add
