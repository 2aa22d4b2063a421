"""Exact, linearly interpolated quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import Profile, attach, longest_series, place

# Values (rows x columns) of a group that one task may hold as value -> count maps: some 200 MB.
GROUP_CELLS = 1 << 22
# Accuracy of the bracketing sketch.
SKETCH = 10_000
# Brackets (groups x columns) that are broadcast: some 10 MB.
FEW_BRACKETS = 1 << 16


def unpivot_numeric(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows ``keys…, column, value`` (double) for the given columns."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    return df.select(*keys, F.explode(F.array(*cells)).alias("__cell")).select(
        *keys, F.col("__cell.column").alias("column"), F.col("__cell.value").alias("value")
    )


def grouped_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    group_rows: int | None = None,
    prof: Profile | None = None,
    largest: int | None = None,
) -> DataFrame:
    """One row per group with an array of quantiles for every column (null if it has no value).

    Groups up to ``group_rows`` rows use the built-in exact aggregate. If any group
    is larger, a sketch brackets every quantile, the rows below a bracket are counted
    and only those inside are ranked, by a distributed running total; no task ever
    holds a group. ``largest`` is the size of the biggest group where the caller
    knows it.
    """
    limit = max(1, GROUP_CELLS // len(columns)) if group_rows is None else group_rows
    if (longest_series(df, keys) if largest is None else largest) <= limit:
        return _small_groups(df, columns, probs, keys)
    if not keys:
        return _large_groups(df, columns, probs, keys, prof)
    # The large groups are few (their number times ``limit`` is at most the table) and
    # stored once; every other group takes the plain aggregate.
    sizes = df.groupBy(F.struct(*keys).alias("__large")).agg(F.count(F.lit(1)).alias("__size"))
    large = cut_lineage(sizes.filter(F.col("__size") > limit).select("__large"))
    tagged = df.withColumn("__gk", F.struct(*keys))
    same = F.col("__gk") == F.col("__large")
    small = _small_groups(tagged.join(large, same, "left_anti"), columns, probs, keys)
    found = _large_groups(tagged.join(large, same, "left_semi"), columns, probs, keys, prof)
    # A large group without any value keeps its row.
    named = found.select(F.struct(*keys).alias("__fk"), *[F.col(f"`{c}`") for c in columns])
    every = large.join(named, F.col("__large") == F.col("__fk"), "left")
    return small.unionByName(
        every.select(*[F.col(f"__large.{k}").alias(k) for k in keys], *[F.col(f"`{c}`") for c in columns])
    )


def _small_groups(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    aggs = [F.percentile(F.col(f"`{c}`").cast("double"), F.lit(list(probs))).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*aggs)


def _large_groups(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str], prof: Profile | None
) -> DataFrame:
    """Quantiles of groups that no task may hold; groups without any value are left out."""
    match = [*keys, "column"]
    rows = unpivot_numeric(df, columns, keys)
    # A sketch (rank error about n / SKETCH) brackets each quantile; small groups are kept
    # whole. A bracket that misses is made wider, in the end as wide as the data.
    reach = 3.0 / SKETCH
    while True:
        picked = cut_lineage(_ranked(rows, match, probs, reach, prof))
        if reach >= 1.0 or picked.filter(F.col("__lo").isNull() | F.col("__hi").isNull()).isEmpty():
            break
        reach *= 16
    answer = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__part")
    parts = picked.select(*match, F.struct("i", answer.alias("q")).alias("__q"))
    arrays = parts.groupBy(*match).agg(F.transform(F.sort_array(F.collect_list("__q")), lambda c: c["q"]).alias("__q"))
    return arrays.groupBy(*keys).agg(
        *[F.max(F.when(F.col("column") == c, F.col("__q"))).alias(c) for c in columns]
    )


def _ranked(rows: DataFrame, match: Sequence[str], probs: Sequence[float], reach: float, prof: Profile | None) -> DataFrame:
    """The values around every wanted rank, null where they lie outside the bracket."""
    wide = [min(1.0, max(0.0, p + side * reach)) for p in probs for side in (-1, 1)]
    size = F.count("value")
    brackets = rows.groupBy(*match).agg(
        size.alias("__n"),
        F.when((size > SKETCH) & F.lit(reach < 1.0), F.percentile_approx("value", wide, SKETCH)).alias("__ends"),
    )
    # Stored, as they are read twice. Few ones go to the rows: else all rows of a column would meet in one task.
    brackets = cut_lineage(brackets)
    if brackets.limit(FEW_BRACKETS + 1).count() <= FEW_BRACKETS:
        brackets = F.broadcast(brackets)
    bounded = attach(rows.filter(F.col("value").isNotNull()), brackets, ["__ends"], match)
    value = F.col("value")
    cells = []
    for i in range(len(probs)):
        low, high = F.get("__ends", F.lit(2 * i)), F.get("__ends", F.lit(2 * i + 1))
        # Rows below a bracket are only counted: they share the null value, which sorts first.
        inside = F.struct(F.lit(i).alias("i"), F.when(low.isNull() | (value >= low), value).alias("v"))
        cells.append(F.when(high.isNull() | (value <= high), inside))
    counts = (
        bounded.select(*match, F.explode(F.array(*cells)).alias("__cell"))
        .filter(F.col("__cell").isNotNull())
        .groupBy(*match, "__cell.i", "__cell.v")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    # What is left is small beside the data; stored once, it is read three times.
    counts = cut_lineage(counts)
    ranked = place(counts, "v", [*match, "i"], start="__from", weight="__c", prof=prof)
    sized = attach(ranked, brackets.select(*match, "__n"), ["__n"], match)
    prob = F.element_at(F.lit([float(p) for p in probs]), F.col("i") + 1)
    rank = prob * (F.col("__n") - 1)
    holds = lambda at: (at >= F.col("__from")) & (at < F.col("__from") + F.col("__c"))
    return sized.groupBy(*match, "i").agg(
        F.max(F.when(holds(F.floor(rank)), F.col("v"))).alias("__lo"),
        F.max(F.when(holds(F.ceil(rank)), F.col("v"))).alias("__hi"),
        F.max(rank - F.floor(rank)).alias("__part"),
    )
