"""The preparation steps over a stream of readings.

The same column functions as in batch; only the bounds that a stream needs are added:
a watermark, and repeated readings dropped within it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import move_to_front
from ..functions.time import epoch_seconds
from ..operators.clean import sentinel_to_null

# A week starts on Monday: four days after the epoch, which was a Thursday.
_WINDOWS = {"D": ("1 day", "0 days"), "W": ("7 days", "4 days")}


def clean_stream(
    df: DataFrame,
    time_col: str,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    late: str = "1 day",
) -> DataFrame:
    """Sentinels to null, one reading per series and time, epoch seconds in front."""
    once = df.withWatermark(time_col, late).dropDuplicatesWithinWatermark([*keys, time_col])
    # The time column itself stays untouched, because it carries the watermark.
    stamped = sentinel_to_null(once, columns).withColumn(f"{time_col}_Timestamp", epoch_seconds(time_col))
    return move_to_front(stamped, [f"{time_col}_Timestamp"])


def median_stream(
    df: DataFrame,
    time_col: str,
    freq: str,
    columns: Sequence[str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Exact medians per day or week of a cleaned stream, emitted when the bin can no longer change.

    Readings are unique in time after :func:`clean_stream`, so a bin of one series is
    bounded by its length. Months have no fixed length and are left to the batch operator.
    """
    if freq not in _WINDOWS:
        raise ValueError("a stream is resampled to days or weeks")
    length, offset = _WINDOWS[freq]
    bins = df.groupBy(*keys, F.window(time_col, length, length, offset).alias("__w"))
    medians = bins.agg(*[F.median(F.col(f"`{c}`")).alias(c) for c in columns])
    label = F.date_sub(F.to_date("__w.end"), 1).alias(time_col)
    flat = medians.select(*keys, label, *[F.col(f"`{c}`") for c in columns])
    return flat.withColumn(f"{time_col}_Timestamp", epoch_seconds(time_col))
