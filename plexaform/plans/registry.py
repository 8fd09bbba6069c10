"""Registry of queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import load

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn
        return wrap

    def expressions(self, name: str, table: str, select: dict[str, str], sql: str | None = None, where: str = "") -> None:
        """A projection given as Spark SQL expressions; the comparison uses ``sql`` or, if the text is shared, the same."""
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = load(spark, sf_dir, table)
            df = df.where(where) if where else df
            return df.selectExpr(*[f"{e} AS {a}" for a, e in select.items()])
        shared = "SELECT " + ", ".join(f"{e} AS {a}" for a, e in select.items()) + f" FROM {table}" + (f" WHERE {where}" if where else "")
        self.add(name, sql or shared)(run)
