"""Named queries and their SQL: modules add to the two dictionaries with the decorators here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemospark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of a folder by attribute, each read when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    __getitem__ = __getattr__


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        """Register ``f(tables)`` as query ``name`` with its DuckDB SQL, where there is one."""

        def wrap(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                self.sql[name] = sql
            return f

        return wrap
