"""Named queries and, where one exists, their plain-SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from pagemill.plans import views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

FAMILIES = [
    "source_queries",
    "link_queries",
    "cleaning_queries",
    "fragment_queries",
    "product_queries",
    "catalog_queries",
    "dataset_queries",
    "streaming_queries",
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; views named in ``sql`` are defined in front of it."""

    def register(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = views.with_views(sql)
        return fn

    return register


def load() -> None:
    for family in FAMILIES:
        import_module(f"pagemill.plans.{family}")


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)
