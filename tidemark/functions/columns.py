"""Renaming, dropping, reordering and selecting columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FEATURES, MEASUREMENT_COLUMNS, METADATA_COLUMNS, TARGET, to_internal_name, to_public_name


def prefix_columns(df: DataFrame, prefix: str) -> DataFrame:
    """Rename the measurement columns to ``<prefix>-<name>``; absent ones are ignored."""
    if not isinstance(prefix, str):
        raise ValueError("prefix must be a string")
    return df.withColumnsRenamed({c: f"{prefix}-{c}" for c in MEASUREMENT_COLUMNS})


def drop_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop the listed columns that exist (by default the metadata columns)."""
    return df.drop(*(METADATA_COLUMNS if columns is None else columns))


def move_to_front(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Given columns first, the others in their order."""
    rest = [c for c in df.columns if c not in set(columns)]
    return df.select(*[f"`{c}`" for c in [*columns, *rest]])


def select_columns(df: DataFrame, columns: Sequence[str], head: int | None = None) -> DataFrame:
    """Explicit projection, optionally a preview of the first rows."""
    out = df.select(*[f"`{c}`" for c in columns])
    return out if head is None else out.limit(head)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns in order."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def to_internal(df: DataFrame) -> DataFrame:
    """Public column names (``PM2.5-Value``) to internal ones (``pm25_value``)."""
    return df.withColumnsRenamed({c: to_internal_name(c) for c in df.columns})


def to_public(df: DataFrame) -> DataFrame:
    """Internal column names to public ones."""
    return df.withColumnsRenamed({c: to_public_name(c) for c in df.columns})


def select_features_target(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``keep…, features (vector), label``."""
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    return assembled.select(*keep, "features", F.col(target).cast("double").alias("label"))
