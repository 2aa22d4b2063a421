"""Sentinels, missing values, validity flags and outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import numeric_columns
from ..schema import SENTINEL
from .ordered import attach, with_group_stats
from .quantiles import grouped_quantiles


def sentinel_to_null(df: DataFrame, columns: Sequence[str] | None = None, sentinel: float = SENTINEL) -> DataFrame:
    """Replace the sentinel (and NaN) by null in every numeric column."""
    fixed = {}
    for name in numeric_columns(df) if columns is None else columns:
        col = F.col(f"`{name}`")
        bad = col == F.lit(sentinel)
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            bad = bad | F.isnan(col)
        fixed[name] = F.when(~bad, col)
    return df.withColumns(fixed)


def impute_missing(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Fill nulls with the column mean, per series if ``keys`` and per group if ``by`` is given.

    A distance-weighted neighbour imputer that sees a single column has no
    distances for a missing row and falls back to this mean.
    """
    names = {f"__mean{i}": F.avg(f"`{c}`") for i, c in enumerate(columns)}
    with_means = with_group_stats(df, names, [*keys, *by])
    filled = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.col(m)) for c, m in zip(columns, names)}
    return with_means.withColumns(filled).drop(*names)


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any (listed) column."""
    return df.dropna(subset=None if columns is None else list(columns))


def filter_validity(df: DataFrame, columns: Sequence[str] = ("Validity",), at_least: int = 1) -> DataFrame:
    """Keep rows whose validity flags reach the threshold."""
    for name in columns:
        df = df.filter(F.col(f"`{name}`") >= at_least)
    return df


def with_iqr_bounds(df: DataFrame, column: str, keys: Sequence[str] = (), factor: float = 1.5, **kw) -> DataFrame:
    """Attach ``q1, q3, lower, upper`` of the series to its rows."""
    quarts = grouped_quantiles(df, [column], [0.25, 0.75], keys, **kw)
    q1, q3 = F.col(f"`{column}`")[0], F.col(f"`{column}`")[1]
    bounds = quarts.select(
        *keys,
        q1.alias("q1"),
        q3.alias("q3"),
        (q1 - factor * (q3 - q1)).alias("lower"),
        (q3 + factor * (q3 - q1)).alias("upper"),
    )
    return attach(df, bounds, ["q1", "q3", "lower", "upper"], keys)


def iqr_outliers(df: DataFrame, column: str, keys: Sequence[str] = (), **kw) -> DataFrame:
    """Rows outside ``[Q1 - 1.5 IQR, Q3 + 1.5 IQR]`` with the bounds they break."""
    value = F.col(f"`{column}`")
    return with_iqr_bounds(df, column, keys, **kw).filter((value < F.col("lower")) | (value > F.col("upper")))


def outlier_share(df: DataFrame, column: str, keys: Sequence[str] = (), **kw) -> DataFrame:
    """Number of outliers and their percentage of all rows."""
    value = F.col(f"`{column}`")
    out = (value < F.col("lower")) | (value > F.col("upper"))
    return (
        with_iqr_bounds(df, column, keys, **kw)
        .groupBy(*keys)
        .agg(
            F.count(F.when(out, 1)).alias("n_outliers"),
            F.try_divide(100.0 * F.count(F.when(out, 1)), F.count(F.lit(1))).alias("pct_outliers"),
        )
    )
