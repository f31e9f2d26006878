"""Queries by name, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmesh.session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is defined twice")

            @functools.wraps(f)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return f(spark, sf_dir)

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return f

        return add
