"""A book of queries: functions of (spark, folder) with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self, prelude: str = "") -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.prelude = prelude

    def add(self, sql: str | None = None, more: str = "") -> Callable[[Query], Query]:
        """Registers the function under its name. sql may use the prelude's and `more`'s common table expressions."""

        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                heads = ", ".join(x.strip().rstrip(",") for x in (self.prelude, more) if x.strip())
                self.sql[f.__name__] = (f"with {heads} " if heads else "") + sql
            return f

        return keep
