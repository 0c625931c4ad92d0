"""Queries over the driver's tables, each an operator on a graph view, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its operator's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = (f, sql)
        return f

    return add


def load() -> dict[str, tuple[Query, str | None]]:
    from . import algorithms, code, relational, retrieval, system  # noqa: F401

    return REGISTRY
