"""The tables of queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import sql_views, table

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register f(t), where t(name) is a table or view; sql may use the named views."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda n: table(spark, sf_dir, n))

        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            if views:
                head = sql_views(*views)
                if body.upper().startswith("WITH RECURSIVE "):
                    head, body = head.replace("WITH ", "WITH RECURSIVE ", 1), "WITH " + body[15:]
                body = f"{head}, {body[5:]}" if body.upper().startswith("WITH ") else f"{head} {body}"
            SQL[name] = body
        return f

    return register
