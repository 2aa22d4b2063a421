"""Chronological splits and expanding time-series folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Profile, with_position


def split_label(pos: Column, total: Column, train_ratio: float = 0.6, validation_ratio: float = 0.2) -> Column:
    """``train``, ``validation`` or ``test`` by position: sizes are ``int(n·ratio)``, the rest is test."""
    if train_ratio < 0 or validation_ratio < 0 or train_ratio + validation_ratio > 1:
        raise ValueError("ratios must be non-negative and sum to at most 1")
    train = F.floor(total * F.lit(train_ratio))
    validation = F.floor(total * F.lit(validation_ratio))
    return F.when(pos < train, "train").when(pos < train + validation, "validation").otherwise("test")


def chronological_split(
    df: DataFrame,
    time_col: str,
    train_ratio: float = 0.6,
    validation_ratio: float = 0.2,
    keys: Sequence[str] = (),
    name: str = "split",
    prof: Profile | None = None,
) -> DataFrame:
    """Add ``pos`` and the split of each row in the time order of its series."""
    placed = with_position(df, time_col, keys, "pos", total="__n", prof=prof)
    label = split_label(F.col("pos"), F.col("__n"), train_ratio, validation_ratio)
    return placed.withColumn(name, label).drop("__n")


def fold_bounds(rows: int, n_splits: int = 5) -> list[tuple[int, int]]:
    """``(train_end, test_end)`` of each expanding fold over ``rows`` positions."""
    size = rows // (n_splits + 1)
    if size == 0:
        raise ValueError(f"{rows} rows are too few for {n_splits} folds")
    return [(rows - (n_splits - i) * size, rows - (n_splits - i - 1) * size) for i in range(n_splits)]


def time_series_folds(
    df: DataFrame,
    time_col: str,
    n_splits: int = 5,
    keys: Sequence[str] = (),
    prof: Profile | None = None,
) -> DataFrame:
    """Rows with ``pos, fold, role``: ``test`` in one fold, ``train`` in every later one."""
    placed = with_position(df, time_col, keys, "pos", total="__n", prof=prof)
    size = F.floor(F.col("__n") / (n_splits + 1))
    cells = []
    for i in range(n_splits):
        start = F.col("__n") - (n_splits - i) * size
        role = F.when(F.col("pos") < start, "train").when(F.col("pos") < start + size, "test")
        cells.append(F.when(role.isNotNull(), F.struct(F.lit(i).alias("fold"), role.alias("role"))))
    spread = placed.withColumn("__cell", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())))
    return spread.select(*[c for c in placed.columns if c != "__n"], "__cell.*")
