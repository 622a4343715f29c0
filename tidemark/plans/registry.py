"""Registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Comparable columns: whole numbers as long, dates and instants as text, doubles to six places."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint") or kind.startswith("decimal(20,0)"):
            c = c.cast("bigint")
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("string")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the DuckDB statement that gives the same rows."""

    def put(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return tidy(f(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return put
