"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with SQL that must give the same rows, or None where SQL cannot express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def wrap(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is there already")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return wrap
