"""Frequencies: medians per day, week and month, regular grids, the four-table family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import drop_columns, move_to_front, numeric_columns
from ..functions.time import STEP, bin_label, check_frequency, epoch_seconds, to_epoch_seconds
from ..schema import FREQUENCIES
from ..session import cut_lineage
from .ordered import Profile, place, profile_with, with_group_stats
from .quantiles import grouped_quantiles


def _label_after(label: Column, freq: str) -> Column:
    if freq == "M":
        return F.last_day(F.add_months(label, 1))
    return label + F.expr(f"INTERVAL {STEP[freq]}")


def fill_gaps(df: DataFrame, label: str, freq: str, keys: Sequence[str] = (), prof: Profile | None = None) -> DataFrame:
    """Insert an all-null row for every label missing between the first and last one of a series.

    Each row yields the empty bins up to its successor, so no spine is built or joined.
    A repeated label is an error.
    """
    check_frequency(freq)
    is_date = isinstance(df.schema[label].dataType, T.DateType)
    with_next = place(df, label, keys, after={"__next": label}, prof=prof)
    here, nxt = F.col(f"`{label}`"), F.col("__next")
    step = F.expr(f"INTERVAL {STEP[freq]}")
    if freq == "M":
        # Month ends have no fixed distance: walk the firsts of the months.
        firsts = F.sequence(F.trunc(here, "month"), F.add_months(F.trunc(nxt, "month"), -1), step)
        stops = F.transform(firsts, lambda d: F.last_day(d))
    else:
        stops = F.sequence(here, (nxt - step).cast("date") if is_date else nxt - step, step)
    repeated = F.raise_error(F.concat(F.lit("repeated time stamp "), here.cast("string")))
    slots = F.when(nxt.isNull(), F.array(here)).when(nxt == here, repeated).otherwise(stops)
    spread = with_next.withColumn("__slot", F.explode(slots))
    kept = {label, *keys}
    cols = [
        F.col("__slot").alias(c) if c == label
        else F.col(f"`{c}`") if c in kept
        else F.when(F.col("__slot") == here, F.col(f"`{c}`")).alias(c)
        for c in df.columns
    ]
    return spread.select(*cols)


def resample_median(
    df: DataFrame,
    time_col: str,
    freq: str,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = (),
    fill_empty: bool = True,
    group_rows: int | None = None,
) -> DataFrame:
    """Median of every numeric column per day, week or month.

    The label is the day, the Sunday ending the week or the last day of the month;
    bins without rows are kept as null rows. Adds ``<time_col>_Timestamp``.
    """
    if freq == "H":
        raise ValueError("hourly data is passed through, not resampled")
    stamp = f"{time_col}_Timestamp"
    if columns is None:
        columns = numeric_columns(df, exclude=[*keys, stamp])
    binned = df.select(*keys, bin_label(time_col, freq).alias(time_col), *[F.col(f"`{c}`") for c in columns])
    # One pass over keys and time gives the biggest bin and the layout of the labels.
    sizes = binned.groupBy(*keys, time_col).agg(F.count(F.lit(1)).alias("__size"))
    prof, largest = profile_with(sizes, time_col, "__size", keys)
    medians = grouped_quantiles(binned, columns, [0.5], [*keys, time_col], group_rows=group_rows, largest=largest or 0)
    flat = medians.select(*keys, time_col, *[F.col(f"`{c}`")[0].alias(c) for c in columns])
    if fill_empty:
        flat = fill_gaps(flat, time_col, freq, keys, prof)
    return flat.withColumn(stamp, epoch_seconds(time_col))


def hourly_passthrough(df: DataFrame, time_col: str = "Start", drop: Sequence[str] = ("End", "End_Timestamp")) -> DataFrame:
    """The hourly table: interval end dropped, epoch seconds in front."""
    return to_epoch_seconds(drop_columns(df, drop), [time_col])


def build_frequencies(
    df: DataFrame,
    time_col: str = "Start",
    keys: Sequence[str] = (),
    fill_empty: bool = True,
    keep: bool = True,
) -> dict[str, DataFrame]:
    """The hourly table and its daily, weekly and monthly medians, all from the frame given.

    ``keep`` stores the hourly table in the shared folder, because every output reads it;
    a table that is stored already needs no such copy.
    """
    if df is None or df.isEmpty():
        raise ValueError("no hourly rows")
    hourly = hourly_passthrough(df, time_col)
    if keep:
        hourly = cut_lineage(hourly)
    out = {"H": hourly}
    for freq in FREQUENCIES[1:]:
        medians = resample_median(hourly, time_col, freq, keys=keys, fill_empty=fill_empty)
        out[freq] = move_to_front(medians, [*keys, time_col, f"{time_col}_Timestamp"])
    return out


def as_frequency(
    df: DataFrame,
    time_col: str,
    freq: str,
    keys: Sequence[str] = (),
    prof: Profile | None = None,
) -> DataFrame:
    """Conform to a regular grid that starts at the first stamp of each series.

    Missing slots become null rows, stamps off the grid are left out, a repeated
    stamp is an error.
    """
    if freq == "M":
        on_grid = df.filter(F.col(time_col).cast("date") == F.last_day(F.col(time_col).cast("date")))
        on_grid = on_grid.withColumn(time_col, F.col(time_col).cast("date"))
    else:
        seconds = {"H": 3600, "D": 86400, "W": 604800}[check_frequency(freq)]
        first = with_group_stats(df, {"__first": F.min(F.col(f"`{time_col}`"))}, keys)
        off = epoch_seconds(time_col) - epoch_seconds("__first")
        on_grid = first.filter(off % seconds == 0).drop("__first")
    return fill_gaps(on_grid, time_col, freq, keys, prof)
