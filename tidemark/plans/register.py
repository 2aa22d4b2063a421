"""Collects registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same computation over the same tables."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Wall-clock times are read as UTC whatever the zone of the machine.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, places: int = 6, columns: Sequence[str] | None = None) -> DataFrame:
    """Doubles rounded, so that the last digits of a sum do not matter."""
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(F.col(f"`{n}`"), places) for n in names})
