"""Aligning several observation tables on their common interval."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import INTERVAL

JOIN_TYPES = ("inner", "left", "right", "outer")


def _merge_two(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    shared = (set(left.columns) & set(right.columns)) - set(on)
    if shared:
        raise ValueError(f"columns present on both sides: {sorted(shared)}")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in on})
    match = F.lit(True)
    for k in on:
        match = match & F.col(f"`{k}`").eqNullSafe(F.col(f"`__r_{k}`"))
    joined = left.join(renamed, match, how)
    if how in ("right", "outer"):
        joined = joined.withColumns({k: F.coalesce(F.col(f"`{k}`"), F.col(f"`__r_{k}`")) for k in on})
    return joined.drop(*[f"__r_{k}" for k in on])


def merge_on_interval(
    frames: Sequence[DataFrame],
    on: Sequence[str] = INTERVAL,
    how: str = "outer",
    sort: bool = False,
) -> DataFrame:
    """Left fold of equi-joins; missing keys match missing keys and duplicates multiply.

    ``sort=True`` also orders the result by the first key, which every later
    operator does for itself where it needs an order.
    """
    if not frames:
        raise ValueError("no frames to merge")
    if how not in JOIN_TYPES:
        raise ValueError(f"unknown join type {how!r}")
    merged = frames[0]
    for other in frames[1:]:
        merged = _merge_two(merged, other, on, how)
    return merged.orderBy(F.asc_nulls_last(on[0])) if sort else merged


def merge_by_pivot(
    df: DataFrame,
    pollutants: Mapping[object, str],
    values: Sequence[str] = ("value",),
    by: str = "pollutant",
    on: Sequence[str] = INTERVAL,
) -> DataFrame:
    """The full outer merge of unique intervals from long rows, in one shuffle.

    ``pollutants`` maps the value of ``by`` to the short name used in
    ``<short>_<value>``. Rows are combined before the shuffle.
    """
    cols = [
        F.max(F.when(F.col(by) == F.lit(code), F.col(v))).alias(f"{short}_{v}")
        for code, short in pollutants.items()
        for v in values
    ]
    return df.filter(F.col(by).isin(*pollutants)).groupBy(*on).agg(*cols)
