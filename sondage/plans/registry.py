"""Where queries register themselves, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql.strip()
        return function

    return register


def keyed_query(sql: str):
    """As ``query``, with line items that are unique by order and number in place of the table."""
    from sondage.plans.adapters import LINES_SQL

    if "lineitem" in sql:
        sql = sql.strip().replace("FROM lineitem", "FROM li").replace("JOIN lineitem", "JOIN li")
        sql = f"WITH {LINES_SQL}, {sql.removeprefix('WITH ')}" if sql.startswith("WITH ") else f"WITH {LINES_SQL} {sql}"
    return query(sql)
