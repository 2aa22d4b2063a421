"""Lagged, rolling, differenced, decomposed and windowed views of ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Profile, attach, over_blocks, place, profile, with_group_stats, with_position


def rolling_mean_std(
    df: DataFrame,
    column: str,
    time_col: str,
    window: int = 12,
    keys: Sequence[str] = (),
    prof: Profile | None = None,
) -> DataFrame:
    """Trailing mean and sample deviation; null until the window holds ``window`` values."""
    value = F.col(f"`{column}`")

    def columns(w):
        frame = w.rowsBetween(-(window - 1), 0)
        full = F.count(value).over(frame) == window
        return {
            "rolling_mean": F.when(full, F.avg(value).over(frame)),
            "rolling_std": F.when(full, F.stddev_samp(value).over(frame)),
        }

    return over_blocks(df, time_col, columns, reach_back=window - 1, keys=keys, prof=prof)


def lag(
    df: DataFrame,
    column: str,
    time_col: str,
    offset: int = 1,
    keys: Sequence[str] = (),
    name: str | None = None,
    prof: Profile | None = None,
) -> DataFrame:
    """Value ``offset`` rows earlier in the series."""
    name = name or f"{column}_lag{offset}"
    if offset == 1:
        return place(df, time_col, keys, before={name: column}, prof=prof)
    return over_blocks(
        df, time_col, lambda w: {name: F.lag(F.col(f"`{column}`"), offset).over(w)}, reach_back=offset, keys=keys, prof=prof
    )


def difference(
    df: DataFrame,
    column: str,
    time_col: str,
    order: int = 2,
    mode: str = "lag",
    keys: Sequence[str] = (),
    prof: Profile | None = None,
) -> DataFrame:
    """Rows ``…, order, diff`` for orders 1..``order``, nulls dropped.

    ``mode="lag"``: ``x[t] - x[t-i]``; ``mode="order"``: the i-times iterated difference.
    """
    if mode not in ("lag", "order"):
        raise ValueError(f"unknown mode {mode!r}")
    value = F.col(f"`{column}`")

    def columns(w):
        back = [value] + [F.lag(value, i).over(w) for i in range(1, order + 1)]
        if mode == "lag":
            return {f"__d{i}": back[0] - back[i] for i in range(1, order + 1)}
        out, weights = {}, [1]
        for i in range(1, order + 1):
            weights = [a - b for a, b in zip([*weights, 0], [0, *weights])]
            out[f"__d{i}"] = sum((back[j] * float(c) for j, c in enumerate(weights)), F.lit(0.0))
        return out

    wide = over_blocks(df, time_col, columns, reach_back=order, keys=keys, prof=prof)
    cells = [F.struct(F.lit(i).alias("order"), F.col(f"__d{i}").alias("diff")) for i in range(1, order + 1)]
    long = wide.withColumn("__cell", F.explode(F.array(*cells)))
    return long.select(*df.columns, "__cell.*").filter(F.col("diff").isNotNull())


def seasonal_decompose(
    df: DataFrame,
    column: str,
    time_col: str,
    period: int = 24,
    keys: Sequence[str] = (),
    prof: Profile | None = None,
) -> DataFrame:
    """Additive ``trend``, ``seasonal`` and ``resid`` of a series without nulls.

    Trend is the centred moving average (half weights at both ends of an even
    period); the seasonal index is the mean detrended value per position modulo the
    period, centred on zero. A series shorter than two periods is an error.
    """
    if period < 1:
        raise ValueError("period must be positive")
    prof = prof or profile(df, time_col, keys)
    series = with_position(df, time_col, keys, "__t", total="__n", prof=prof)
    short = F.raise_error(F.lit(f"a series needs at least {2 * period} values"))
    series = series.withColumn("__x", F.when(F.col("__n") < 2 * period, short).otherwise(F.col(f"`{column}`").cast("double")))
    half = period // 2
    even = period % 2 == 0

    def columns(w):
        x = F.col("__x")
        whole = (F.col("__t") >= half) & (F.col("__t") < F.col("__n") - half)
        if even:
            ends = F.sum(x).over(w.rowsBetween(-half, half - 1)) + F.sum(x).over(w.rowsBetween(-half + 1, half))
            centred = ends / (2.0 * period)
        else:
            centred = F.avg(x).over(w.rowsBetween(-half, half))
        return {"trend": F.when(whole, centred)}

    trended = over_blocks(
        series, time_col, columns, reach_back=half, reach_ahead=half, keys=keys, prof=prof, position="__t"
    )
    slot = F.col("__t") % period
    # Reads the same columns as the result below, so that Spark shuffles the blocks once for both.
    present = F.col(f"`{time_col}`").isNotNull() & F.col(f"`{column}`").isNotNull()
    detrended = F.when(present, F.col("__x") - F.col("trend"))
    means = trended.groupBy(*keys, slot.alias("__slot")).agg(F.avg(detrended).alias("__m"))
    # One array of ``period`` numbers per series: looked up by slot, so rows are not shuffled by it.
    pairs = with_group_stats(means, {"__mm": F.avg("__m")}, keys).select(
        *keys, F.struct("__slot", (F.col("__m") - F.col("__mm")).alias("__s")).alias("__pair")
    )
    index = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list("__pair")).alias("__index"))
    seasonal = F.get("__index", slot.cast("int"))["__s"]
    return attach(trended, index, ["__index"], keys).select(
        *[F.col(f"`{c}`") for c in df.columns],
        "trend",
        seasonal.alias("seasonal"),
        (F.col("__x") - F.col("trend") - seasonal).alias("resid"),
    )


def create_windows(
    df: DataFrame,
    channels: Sequence[str],
    time_col: str,
    window: int = 24,
    keys: Sequence[str] = (),
    prof: Profile | None = None,
) -> DataFrame:
    """Sliding windows: ``pos``, ``x`` = rows ``pos … pos+window-1``, ``y`` = row ``pos+window``.

    Positions run from 0 to ``n - window - 2``; the last possible window is left out.
    ``n_windows`` is their number in the series.
    """
    prof = prof or profile(df, time_col, keys)
    placed = with_position(df, time_col, keys, "pos", total="__n", prof=prof)
    row = F.array(*[F.col(f"`{c}`").cast("double") for c in channels])

    def columns(w):
        return {
            "x": F.collect_list(F.col("__row")).over(w.rowsBetween(0, window - 1)),
            "y": F.lead(F.col("__row"), window).over(w),
            "y_time": F.lead(F.col(time_col), window).over(w),
        }

    narrow = placed.select(*keys, time_col, "pos", "__n", row.alias("__row"))
    wide = over_blocks(narrow, time_col, columns, reach_ahead=window, keys=keys, prof=prof, position="pos")
    return wide.filter(F.col("pos") <= F.col("__n") - window - 2).select(
        *keys, "pos", (F.col("__n") - window - 1).alias("n_windows"), "y_time", "x", "y"
    )
