"""Registry of named queries, each a callable (spark, folder) -> DataFrame with an optional SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quillon.session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")

            @wraps(f)
            def run(spark: SparkSession, folder: str) -> DataFrame:
                ship(spark)
                return f(spark, folder)

            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return f

        return add


def typed(sql: str, kind: str, *columns: str) -> str:
    """``sql`` with ``columns`` cast to ``kind``, where SQL's own type differs from the query's."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {kind}) AS {c}' for c in columns)}) FROM ({sql})"
