"""Registry of named queries and of the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated function as query ``name``; ``sql`` is its ANSI counterpart."""

        def add(run: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")

            @wraps(run)
            def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship_package(spark)
                return run(spark, sf_dir)

            self.queries[name] = shipped
            if sql is not None:
                self.sql[name] = sql
            return run

        return add


CORE = Registry()
