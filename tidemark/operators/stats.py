"""Descriptive statistics and the tables behind distribution plots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns
from .clean import outlier_share
from .ordered import attach, with_group_stats
from .quantiles import grouped_quantiles


def _numeric(df: DataFrame, columns: Sequence[str] | None, keys: Sequence[str]) -> list[str]:
    columns = numeric_columns(df, exclude=keys) if columns is None else list(columns)
    if not columns:
        raise ValueError("no numeric columns")
    return columns


def _melt(df: DataFrame, keys: Sequence[str], cells: Sequence[Column]) -> DataFrame:
    """One row per struct in ``cells``."""
    exploded = df.select(*keys, F.explode(F.array(*cells)).alias("__cell"))
    return exploded.select(*keys, "__cell.*")


def describe(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = (), **kw) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum of each numeric column, one row per column."""
    columns = _numeric(df, columns, keys)
    quarts = grouped_quantiles(df, columns, [0.25, 0.5, 0.75], keys, **kw)
    aggs = []
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`").cast("double")
        aggs += [
            F.count(col).alias(f"__n{i}"),
            F.avg(col).alias(f"__a{i}"),
            F.stddev_samp(col).alias(f"__s{i}"),
            F.min(col).alias(f"__l{i}"),
            F.max(col).alias(f"__h{i}"),
        ]
    moments = df.groupBy(*keys).agg(*aggs)
    rows = _melt(
        moments,
        keys,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"__n{i}").alias("count"),
                F.col(f"__a{i}").alias("mean"),
                F.col(f"__s{i}").alias("std"),
                F.col(f"__l{i}").alias("min"),
                F.col(f"__h{i}").alias("max"),
            )
            for i, c in enumerate(columns)
        ],
    )
    ranks = _melt(
        quarts,
        keys,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"`{c}`")[0].alias("p25"),
                F.col(f"`{c}`")[1].alias("p50"),
                F.col(f"`{c}`")[2].alias("p75"),
            )
            for c in columns
        ],
    )
    match = [*keys, "column"]
    paired = rows.withColumn("__k", F.struct(*match)).join(
        ranks.select(F.struct(*match).alias("__rk"), "p25", "p50", "p75"), F.col("__k") == F.col("__rk")
    )
    return paired.select(*match, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def skewness(df: DataFrame, column: str, keys: Sequence[str] = (), tolerance: float = 0.0) -> DataFrame:
    """Population skewness and its verdict."""
    skew = df.groupBy(*keys).agg(F.skewness(F.col(f"`{column}`").cast("double")).alias("skewness"))
    verdict = (
        F.when(F.col("skewness") > tolerance, "right")
        .when(F.col("skewness") < -tolerance, "left")
        .when(F.col("skewness").isNotNull(), "symmetric")
    )
    return skew.withColumn("verdict", verdict)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every ordered pair over the rows where both are present.

    One aggregate over the table; a constant column gives null.
    """
    columns = _numeric(df, columns, keys)
    aggs, cells = [], []
    for i, a in enumerate(columns):
        present = F.count(F.col(f"`{a}`"))
        spread = F.stddev_pop(F.col(f"`{a}`").cast("double"))
        aggs.append(F.when((present > 0) & (spread > 0), 1.0).alias(f"__d{i}"))
        cells.append(F.struct(F.lit(a).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"__d{i}").alias("r")))
    for i, j in combinations(range(len(columns)), 2):
        x, y = (F.col(f"`{columns[k]}`").cast("double") for k in (i, j))
        scale = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
        aggs.append(F.try_divide(F.covar_pop(x, y), scale).alias(f"__r{i}_{j}"))
        for a, b in ((i, j), (j, i)):
            cells.append(
                F.struct(F.lit(columns[a]).alias("col_a"), F.lit(columns[b]).alias("col_b"), F.col(f"__r{i}_{j}").alias("r"))
            )
    return _melt(df.groupBy(*keys).agg(*aggs), keys, cells)


def bin_index(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based equal-width bin; the top edge belongs to the last bin and a flat column to bin 0."""
    at = F.floor((value - lo) * bins / F.when(hi > lo, hi - lo).otherwise(1.0))
    return F.least(at.cast("bigint"), F.lit(bins - 1).cast("bigint"))


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 15, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins for each numeric column, empty bins included; NaN counts as missing."""
    columns = _numeric(df, columns, keys)
    stats, cells, ranges = {}, [], []
    for i, c in enumerate(columns):
        value = F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
        stats[f"__lo{i}"], stats[f"__hi{i}"] = F.min(value), F.max(value)
        at = bin_index(value, F.col(f"__lo{i}"), F.col(f"__hi{i}"), bins)
        cells.append(F.struct(F.lit(c).alias("column"), at.alias("bin")))
        ranges.append(F.struct(F.lit(c).alias("column"), F.col(f"__lo{i}").alias("lo"), F.col(f"__hi{i}").alias("hi")))
    placed = with_group_stats(df.select(*keys, *[f"`{c}`" for c in columns]), stats, keys)
    # Combined before the shuffle: at most ``bins`` rows per column, series and task.
    counts = _melt(placed, keys, cells).filter(F.col("bin").isNotNull()).groupBy(
        F.struct(*keys, "column", "bin").alias("__k")
    ).agg(F.count(F.lit(1)).alias("n"))
    slots = F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))
    edges = _melt(df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), keys, ranges)
    grid = edges.filter(F.col("lo").isNotNull()).withColumn("bin", F.explode(slots))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, F.struct(*keys, "column", "bin") == F.col("__k"), "left").select(
        *keys,
        "column",
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


# A Gaussian kernel nine bandwidths away adds less than one unit in the last place of the peak.
KERNEL_REACH = 9.0


def kde(
    df: DataFrame,
    column: str,
    keys: Sequence[str] = (),
    points: int = 200,
    cut: float = 3.0,
) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth by Scott's rule.

    A value reaches only the grid points within ``KERNEL_REACH`` bandwidths, and the
    sums are combined before the shuffle, which carries at most ``points`` rows per
    series and task.
    """
    data = df.select(*keys, F.col(f"`{column}`").cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    v = F.col("__v")
    basics = {
        "__n": F.count(v),
        "__bw": F.pow(F.count(v).cast("double"), F.lit(-0.2)) * F.stddev_samp(v),
        "__lo": F.min(v),
        "__hi": F.max(v),
    }
    x0 = (F.col("__lo") - cut * F.col("__bw")).alias("__x0")
    dx = ((F.col("__hi") - F.col("__lo") + 2 * cut * F.col("__bw")) / (points - 1)).alias("__dx")
    shape = ["__n", "__bw", "__x0", "__dx"]
    rows = with_group_stats(data, basics, keys).filter(F.col("__bw") > 0).select(*keys, "__v", "__n", "__bw", x0, dx)
    near = lambda sign: (v + sign * KERNEL_REACH * F.col("__bw") - F.col("__x0")) / F.col("__dx")
    first = F.greatest(F.ceil(near(-1)), F.lit(0).cast("bigint"))
    last = F.least(F.floor(near(1)), F.lit(points - 1).cast("bigint"))
    hits = rows.withColumn("__p", F.explode(F.sequence(first, last)))
    z = (F.col("__x0") + F.col("__p") * F.col("__dx") - v) / F.col("__bw")
    sums = hits.groupBy(F.struct(*keys, "__p").alias("__k")).agg(F.sum(F.exp(-0.5 * z * z)).alias("__mass"))
    slots = F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))
    grid = (
        data.groupBy(*keys)
        .agg(*[c.alias(n) for n, c in basics.items()])
        .filter(F.col("__bw") > 0)
        .select(*keys, "__n", "__bw", x0, dx)
        .select(*keys, *shape, F.explode(slots).alias("__p"))
    )
    scale = F.col("__n") * F.col("__bw") * F.sqrt(F.lit(2.0) * F.pi())
    return grid.join(sums, F.struct(*keys, "__p") == F.col("__k"), "left").select(
        *keys,
        F.col("__p").alias("point"),
        (F.col("__x0") + F.col("__p") * F.col("__dx")).alias("x"),
        (F.coalesce("__mass", F.lit(0.0)) / scale).alias("density"),
    )


def box_stats(df: DataFrame, column: str, keys: Sequence[str] = (), **kw) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 IQR) and the number of fliers."""
    value = F.col(f"`{column}`")
    cuts = grouped_quantiles(df, [column], [0.25, 0.5, 0.75], keys, **kw)
    quarters = cuts.select(*keys, *[value[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    bounded = attach(df, quarters, ["q1", "median", "q3"], keys)
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (value >= F.col("q1") - spread) & (value <= F.col("q3") + spread)
    ends = bounded.groupBy(*keys).agg(
        *[F.first(n).alias(n) for n in ("q1", "median", "q3")],
        F.min(F.when(inside, value)).alias("whisker_low"),
        F.max(F.when(inside, value)).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("n_fliers"),
    )
    return ends.select(*keys, "q1", "median", "q3", "whisker_low", "whisker_high", "n_fliers")


def pair_bins(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 15, keys: Sequence[str] = ()) -> DataFrame:
    """Two-dimensional bin counts for every pair of numeric columns (the scatter matrix at any size)."""
    columns = _numeric(df, columns, keys)
    stats = {}
    for i, c in enumerate(columns):
        stats[f"__lo{i}"] = F.min(F.col(f"`{c}`").cast("double"))
        stats[f"__hi{i}"] = F.max(F.col(f"`{c}`").cast("double"))
    placed = with_group_stats(df.select(*keys, *[f"`{c}`" for c in columns]), stats, keys)
    slots = {
        f"__b{i}": bin_index(F.col(f"`{c}`").cast("double"), F.col(f"__lo{i}"), F.col(f"__hi{i}"), bins)
        for i, c in enumerate(columns)
    }
    cells = [
        F.struct(
            F.lit(columns[i]).alias("col_x"),
            F.lit(columns[j]).alias("col_y"),
            F.col(f"__b{i}").alias("bin_x"),
            F.col(f"__b{j}").alias("bin_y"),
        )
        for i, j in combinations(range(len(columns)), 2)
    ]
    # The fan-out is combined before the shuffle, which carries at most pairs x bins^2 rows per task.
    pairs = placed.withColumns(slots).select(*keys, F.explode(F.array(*cells)).alias("__cell")).select(*keys, "__cell.*")
    return (
        pairs.filter(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
        .groupBy(*keys, "col_x", "col_y", "bin_x", "bin_y")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def residual_report(predictions: DataFrame, keys: Sequence[str] = (), **kw) -> DataFrame:
    """Describe table of ``actual - predicted``."""
    residual = F.col("actual") - F.col("predicted")
    return describe(predictions.select(*keys, residual.alias("residual")), ["residual"], keys, **kw)


def _metric_rows(df: DataFrame, metric: str, item, value) -> DataFrame:
    return df.select(F.lit(metric).alias("metric"), item.cast("string").alias("item"), value.cast("double").alias("value"))


def summary_report(
    df: DataFrame,
    target: str,
    time_col: str,
    max_lag: int = 10,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Long-form report ``metric, item, value`` of one table.

    Shape and correlation of every numeric column; skew, outliers, autocorrelation and
    stationarity of the target; with ``features`` also their importance in a forest.
    """
    from .timestats import acf, adf_test

    columns = numeric_columns(df)
    names = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")
    shape = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]
    share = outlier_share(df, target)
    series = df.select(time_col, target).filter(F.col(target).isNotNull())
    on_target = F.lit(target)
    parts = [
        _melt(describe(df, columns), ["column"], shape).select("metric", F.col("column").alias("item"), "value"),
        _metric_rows(skewness(df, target), "skewness", on_target, F.col("skewness")),
        _metric_rows(share, "n_outliers", on_target, F.col("n_outliers")),
        _metric_rows(share, "pct_outliers", on_target, F.col("pct_outliers")),
        _metric_rows(correlation_matrix(df, columns), "correlation", F.concat_ws("~", "col_a", "col_b"), F.col("r")),
        _metric_rows(acf(series, target, time_col, max_lag), "acf", F.col("lag"), F.col("acf")),
        _metric_rows(adf_test(series, target, time_col), "adf_p_value", on_target, F.col("p_value")),
    ]
    if features:
        from ..models.tabular import feature_importance

        complete = df.dropna(subset=[target, *features])
        ranked = feature_importance(complete, time_col, features, target)
        parts.append(_metric_rows(ranked, "importance", F.col("feature"), F.col("importance")))
    return reduce(DataFrame.unionByName, parts)


def frequency_report(tables: Mapping[str, DataFrame], target: str, time_col: str, max_lag: int = 10) -> DataFrame:
    """The report of every table of a frequency family, with its frequency."""
    parts = [summary_report(df, target, time_col, max_lag).withColumn("freq", F.lit(f)) for f, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
