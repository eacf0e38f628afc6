"""The registry to which query modules add their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, ints: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows.

    ints: columns that are 32-bit integers here and 64-bit ones in the SQL.
    """
    if sql and ints:
        casts = ", ".join(f'CAST("{c}" AS INTEGER) AS "{c}"' for c in ints.split())
        sql = f"SELECT * REPLACE ({casts}) FROM ({sql})"

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
