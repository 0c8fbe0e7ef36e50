"""Collects (query, check SQL) pairs by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nightsieve.catalog import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; `needs` names the views the SQL reads."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            body = sql.strip()
            ctes = ", ".join(f"{v} as ({views.CHECK_SQL[v].strip()})" for v in needs)
            if ctes:
                body = f"with {ctes}{', ' + body[5:] if body.lower().startswith('with ') else ' ' + body}"
            CHECKS[name] = body
        return function

    return register
