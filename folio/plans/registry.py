"""Where modules of queries put them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function by its name, with the SQL that gives the same rows if there is any."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def fixed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of literals."""
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """The same as SQL."""

    def literal(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(literal, x)) + "]"
        if isinstance(x, float):
            return f"CAST({x!r} AS DOUBLE)"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({names})"
