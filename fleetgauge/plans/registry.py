"""Registered queries: a Spark callable and, where SQL can say it, the SQL to check it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.plans.views import VIEWS, Views

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register `fn(views) -> DataFrame` under `name`.

    `views` lists the domain views that `sql` starts from; their texts are put
    in front of it.
    """

    def add(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = _with_views(views.split(), sql)
        return fn

    return add


def _with_views(names: list[str], sql: str) -> str:
    body = sql.strip()
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(lead):
            return f"{lead}{ctes},\n{body[len(lead):]}"
    return f"WITH {ctes}\n{body}"


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(fn: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(Views(spark, folder))

    return {name: bound(fn) for name, fn in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    return dict(_SQL)
