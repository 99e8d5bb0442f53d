"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name (or ``name``), with its SQL if there is any."""

    def register(function):
        key = name or function.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is there already")
        QUERIES[key] = function
        if sql:
            ORACLES[key] = sql
        return function

    return register
