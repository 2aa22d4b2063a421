"""Time parsing, epoch seconds, bin labels and periodic features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CHANNELS, FREQUENCIES
from .columns import move_to_front

# Periods in seconds and the periods used at each frequency.
PERIODS = {
    "hour": 3600.0,
    "day": 86400.0,
    "week": 604800.0,
    "month": 30.44 * 86400.0,
    "year": 365.2425 * 86400.0,
}
PERIODS_BY_FREQUENCY = {
    "H": ("day", "hour", "week"),
    "D": ("day", "week"),
    "W": ("week", "month"),
    "M": ("month", "year"),
}
# Text formats of the time column.
HOUR_FORMAT = "yyyy-MM-dd HH:mm:ss"
DAY_FORMAT = "yyyy-MM-dd"

STEP = {"H": "1 hour", "D": "1 day", "W": "7 days", "M": "1 month"}


def check_frequency(freq: str) -> str:
    if freq not in FREQUENCIES:
        raise ValueError(f"unknown frequency {freq!r}; expected one of {FREQUENCIES}")
    return freq


def epoch_seconds(column: str | Column) -> Column:
    """Seconds since 1970 of a wall-clock time, rounded down also before 1970."""
    col = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.unix_seconds(F.to_timestamp(col))


def to_epoch_seconds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parse each column to a timestamp, add ``<col>_Timestamp`` and move the new columns to the front."""
    parsed = df.withColumns({c: F.to_timestamp(F.col(f"`{c}`")) for c in columns})
    stamped = parsed.withColumns({f"{c}_Timestamp": epoch_seconds(c) for c in columns})
    return move_to_front(stamped, [f"{c}_Timestamp" for c in columns])


def parse_time(df: DataFrame, column: str, freq: str, fmt: str | None = None) -> DataFrame:
    """Parse the text time column with the format of its frequency."""
    fmt = fmt or (HOUR_FORMAT if check_frequency(freq) == "H" else DAY_FORMAT)
    return df.withColumn(column, F.to_timestamp(F.col(f"`{column}`"), fmt))


def bin_label(column: str | Column, freq: str) -> Column:
    """Label of the time bin: the hour, the day, the Sunday ending the week, the last day of the month."""
    col = F.col(f"`{column}`") if isinstance(column, str) else column
    check_frequency(freq)
    if freq == "H":
        return F.date_trunc("hour", col)
    if freq == "D":
        return F.to_date(col)
    if freq == "W":
        return F.date_add(F.to_date(F.date_trunc("week", col)), 6)
    return F.last_day(F.to_date(col))


def add_time_features(df: DataFrame, column: str, freq: str) -> DataFrame:
    """Sine and cosine of the epoch seconds for the periods of the frequency."""
    seconds = F.col(f"`{column}`").cast("double")
    cols = {}
    for period in PERIODS_BY_FREQUENCY[check_frequency(freq)]:
        angle = seconds * F.lit(2 * math.pi / PERIODS[period])
        cols[f"{period}_sin"] = F.sin(angle)
        cols[f"{period}_cos"] = F.cos(angle)
    return df.withColumns(cols)


def time_feature_names(freq: str) -> list[str]:
    return [f"{p}_{f}" for p in PERIODS_BY_FREQUENCY[check_frequency(freq)] for f in ("sin", "cos")]


def preprocess_time_series(
    df: DataFrame,
    time_col: str,
    freq: str,
    columns: Sequence[str] = CHANNELS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Time, keys, the five channels and their periodic time features."""
    picked = df.select(*keys, time_col, *columns).withColumn("__seconds", epoch_seconds(time_col))
    return add_time_features(picked, "__seconds", freq).drop("__seconds")
