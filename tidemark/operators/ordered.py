"""Ordered operators that never put a whole series into one task.

A window without a bound on its partition sends a long series to a single task.
Instead the rows are cut into buckets at quantiles of the order column: a bucket
holds about ``rows / buckets`` rows whatever the distribution of keys, so a
group ``(key, bucket)`` is bounded even if one key owns the whole table.
Positions, running totals and neighbours are then stitched together through one
small row per ``(key, bucket)``. Frames that reach further use blocks of
positions with copies of the bordering rows (``over_blocks``).

Rows have one total order on every path: by the order column, nulls first and NaN
with infinity last, then by a hash of the whole row. A value that fills several
buckets, a hot time, is cut at that hash.

Cut points are computed once, eagerly, and enter the plan as constants (their second
level, for tables of billions of rows, as a stored table); both sides of the stitching
join and any recomputation after a lost executor see the same buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

# A series of up to this many rows may be sorted by one task.
PLAIN_ROWS = 1 << 18
BUCKET_ROWS = 1 << 19
# Buckets of one level; a second level divides each of them again.
MAX_BUCKETS = 1 << 12
BLOCK_ROWS = 1 << 16
# Sketches are merged in so many groups first, and then in one.
MERGES = 256
SKETCH_SIZE = 4 * MAX_BUCKETS


@dataclass(frozen=True)
class Profile:
    """Row count of a table and its bucket cut points along the order column.

    Without cut points every series is short and a plain window per series will do. A
    cut point that is listed twice or more is a value that fills whole buckets.
    """

    rows: int
    cuts: tuple = ()
    finer: DataFrame | None = None

    @property
    def plain(self) -> bool:
        return not self.cuts


def order_value(df: DataFrame, column: str) -> Column:
    """The order column as a number that sorts alike; null counts as the smallest, NaN as the largest."""
    dtype, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(dtype, T.TimestampNTZType):
        whole = F.unix_micros(value.cast("timestamp"))
    elif isinstance(dtype, T.TimestampType):
        whole = F.unix_micros(value)
    elif isinstance(dtype, T.DateType):
        whole = F.unix_date(value).cast("bigint")
    elif isinstance(dtype, T.IntegralType):
        whole = value.cast("bigint")
    elif isinstance(dtype, (T.DecimalType, T.FractionalType)):
        number = value.cast("double")
        infinite = F.lit(float("inf"))
        return F.when(number.isNull(), -infinite).when(F.isnan(number), infinite).otherwise(number)
    else:
        raise TypeError(f"rows cannot be ordered by {column} of type {dtype.simpleString()}")
    return F.coalesce(whole, F.lit(-(1 << 63)))


def tie_value(df: DataFrame) -> Column:
    """A hash of the whole row, 63 bits: the order of rows with equal order values."""
    plain = [f"`{f.name}`" for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.shiftrightunsigned(F.xxhash64(*plain), 1)


def total_order(df: DataFrame, column: str) -> list[Column]:
    """Sort expressions that order all rows of a series, equal for the same rows everywhere."""
    return [order_value(df, column), tie_value(df)]


def profile(df: DataFrame, order_by: str, keys: Sequence[str] = ()) -> Profile:
    """Passes over the order column and the keys alone; the result has at most ``MAX_BUCKETS`` numbers."""
    return profile_with(df, order_by, None, keys)[0]


def longest_series(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest group; counts are combined before the shuffle."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _sketches(kind: str):
    return (getattr(F, f"kll_{name}_{kind}") for name in ("sketch_agg", "merge_agg", "sketch_get_quantile"))


def _ranks(parts: int) -> Column:
    """The ranks between equal parts, as SQL text: thousands of literals are slow to hand over one by one."""
    return F.expr("array(" + ", ".join(f"{i / parts}D" for i in range(1, parts)) + ")")


def profile_with(df: DataFrame, order_by: str, largest: str | None, keys: Sequence[str] = ()) -> tuple[Profile, object]:
    """The profile and the largest value of one more column, from the same pass.

    With keys the sizes of the series come first: no sketch is needed if all are short.
    Sketches of the tasks are merged in groups before the last merge, so that no task reads
    one of every other.
    """
    if keys:
        held = (F.max(F.col(f"`{largest}`")) if largest else F.lit(None).cast("bigint")).alias("x")
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), held)
        row = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("x").alias("x")).first()
        if (row["n"] or 0) <= PLAIN_ROWS or row["most"] <= PLAIN_ROWS:
            return Profile(row["n"] or 0), row["x"]
    narrow = df.select(order_value(df, order_by).alias("__o"), (F.col(f"`{largest}`") if largest else F.lit(None).cast("bigint")).alias("__x"))
    sketch, merge, quantile = _sketches(narrow.schema["__o"].dataType.simpleString())
    groups = narrow.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("__g")).agg(
        F.count(F.lit(1)).alias("n"), sketch("__o", F.lit(SKETCH_SIZE)).alias("s"), F.max("__x").alias("x")
    )
    row = groups.agg(F.sum("n").alias("n"), merge("s", F.lit(SKETCH_SIZE)).alias("s"), F.max("x").alias("x")).first()
    rows = row["n"] or 0
    if rows <= PLAIN_ROWS:
        return Profile(rows), row["x"]
    wanted = -(-rows // BUCKET_ROWS)
    buckets = min(MAX_BUCKETS, max(2, wanted))
    held = df.sparkSession.createDataFrame([(bytes(row["s"]),)], "s binary")
    made = Profile(rows, tuple(held.select(quantile("s", _ranks(buckets))).first()[0]))
    if wanted > MAX_BUCKETS:
        ranks = _ranks(-(-wanted // MAX_BUCKETS))
        placed = df.select(order_value(df, order_by).alias("__o"), _coarse(df, order_by, made.cuts).alias("__c"))
        inner = placed.groupBy("__c").agg(quantile(sketch("__o", F.lit(SKETCH_SIZE)), ranks).alias("__cuts"))
        made = Profile(rows, made.cuts, cut_lineage(inner.withColumnRenamed("__c", "__fc")))
    return made, row["x"]


def _count_cuts(points: Column, reached: Callable[[Column], Column], most: int) -> Column:
    """Number of sorted cut points that are reached, by binary search."""
    steps, step = [], 1
    while step <= most:
        steps.insert(0, step)
        step *= 2
    return F.aggregate(
        F.lit(steps), F.lit(0), lambda at, by: F.when(reached(F.get(points, at + by - 1)), at + by).otherwise(at)
    )


def _between(order: Column, tie: Column, points: Column, most: int, repeated: bool) -> Column:
    """Number of cut points at or below a row; a value with several cuts is spread over them by its hash."""
    upper = _count_cuts(points, lambda p: order >= p, most)
    if not repeated:
        return upper
    copies = upper - _count_cuts(points, lambda p: order > p, most)
    part = F.floor(tie / F.lit(float(1 << 63)) * copies).cast("int")
    return F.when(copies > 1, upper - copies + 1 + F.least(part, copies - 1)).otherwise(upper)


def _number(value) -> str:
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"
    # The smallest bigint has no literal of its own.
    return f"{value}L" if value > -(1 << 63) else f"({value + 1}L - 1L)"


def _coarse(df: DataFrame, order_by: str, cuts: Sequence) -> Column:
    points = F.expr("array(" + ", ".join(map(_number, cuts)) + ")")
    return _between(order_value(df, order_by), tie_value(df), points, len(cuts), len(set(cuts)) < len(cuts))


def _with_bucket(df: DataFrame, order_by: str, prof: Profile) -> DataFrame:
    """Add ``__b``, the bucket of every row."""
    # As a generated column, the bucket is a plain value to the optimizer, which would
    # otherwise derive filters from the search on either side of the stitching join.
    if prof.finer is None:
        return df.withColumn("__b", F.explode(F.array(_coarse(df, order_by, prof.cuts))))
    placed = df.withColumn("__c", _coarse(df, order_by, prof.cuts)).join(prof.finer, F.col("__c") == F.col("__fc"))
    inner = _between(order_value(df, order_by), tie_value(df), F.col("__cuts"), 1 << 30, True)
    bucket = F.col("__c").cast("bigint") * (1 << 31) + inner
    return placed.withColumn("__b", F.explode(F.array(bucket))).drop("__c", "__fc", "__cuts")


def place(
    df: DataFrame,
    order_by: str,
    keys: Sequence[str] = (),
    *,
    start: str | None = None,
    total: str | None = None,
    weight: str | None = None,
    before: Mapping[str, str] | None = None,
    after: Mapping[str, str] | None = None,
    prof: Profile | None = None,
) -> DataFrame:
    """Add position and neighbours of every row within its series.

    ``start``: rows (or the sum of ``weight``) ahead of this row; ``total``: the
    same over the series; ``before``/``after``: new column -> column taken from
    the previous/next row. The data is shuffled once.
    """
    prof = prof or profile(df, order_by, keys)
    before, after = dict(before or {}), dict(after or {})
    if prof.plain:
        return _place_plain(df, order_by, keys, start, total, weight, before, after)

    tagged = _with_bucket(df, order_by, prof)
    tagged = tagged.withColumns({
        "__k": F.struct(*keys) if keys else F.struct(F.lit(0)), "__o": order_value(df, order_by), "__t": tie_value(df),
    })
    size = F.sum(weight) if weight else F.count(F.lit(1))
    picks = [size.alias("__n")]
    # One number for both parts of the order keeps the aggregate a hash aggregate; doubles need a struct.
    if tagged.schema["__o"].dataType == T.LongType():
        order = F.col("__o").cast("decimal(20,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + F.col("__t")
    else:
        order = F.struct("__o", "__t")
    picks += [F.max_by(F.col(f"`{c}`"), order).alias(f"__last_{n}") for n, c in before.items()]
    if after:
        picks.append(F.count(F.lit(1)).alias("__rows"))
        picks += [F.min_by(F.col(f"`{c}`"), order).alias(f"__first_{n}") for n, c in after.items()]
    # One row per (series, bucket): a window here holds one row for BUCKET_ROWS of a series.
    along = Window.partitionBy("__k").orderBy("__b")
    edges = tagged.groupBy("__k", "__b").agg(*picks)
    zero = F.lit(0).cast(edges.schema["__n"].dataType)
    edge_cols = [F.col("__k").alias("__ek"), F.col("__b").alias("__eb")]
    edge_cols.append(
        F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), zero).alias("__off")
    )
    edge_cols.append(F.sum("__n").over(Window.partitionBy("__k")).alias("__total"))
    edge_cols += [F.lag(f"__last_{n}").over(along).alias(f"__prev_{n}") for n in before]
    edge_cols += [F.lead(f"__first_{n}").over(along).alias(f"__next_{n}") for n in after]
    if after:
        edge_cols.append(F.col("__rows"))
    edges = edges.select(*edge_cols)

    inside = Window.partitionBy("__k", "__b").orderBy("__o", "__t")
    cols = {"__rn": F.row_number().over(inside)}
    if weight:
        cols["__run"] = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    for name, c in before.items():
        cols[f"__p_{name}"] = F.lag(F.col(f"`{c}`")).over(inside)
    for name, c in after.items():
        cols[f"__f_{name}"] = F.lead(F.col(f"`{c}`")).over(inside)
    placed = tagged.withColumns(cols).join(
        edges, (F.col("__k") == F.col("__ek")) & (F.col("__b") == F.col("__eb"))
    )
    out = [F.col(f"`{c}`") for c in df.columns]
    if start:
        run = F.coalesce(F.col("__run"), zero) if weight else F.col("__rn") - 1
        out.append((F.col("__off") + run).alias(start))
    if total:
        out.append(F.col("__total").alias(total))
    for name in before:
        out.append(
            F.when(F.col("__rn") == 1, F.col(f"__prev_{name}")).otherwise(F.col(f"__p_{name}")).alias(name)
        )
    for name in after:
        out.append(
            F.when(F.col("__rn") == F.col("__rows"), F.col(f"__next_{name}")).otherwise(F.col(f"__f_{name}")).alias(name)
        )
    return placed.select(*out)


def _place_plain(df, order_by, keys, start, total, weight, before, after) -> DataFrame:
    series = Window.partitionBy(*keys)
    along = series.orderBy(*total_order(df, order_by))
    cols = {}
    if start and weight:
        run = F.sum(weight).over(along.rowsBetween(Window.unboundedPreceding, -1))
        cols[start] = F.coalesce(run, F.lit(0))
    elif start:
        cols[start] = (F.row_number().over(along) - 1).cast("bigint")
    if total:
        cols[total] = (F.sum(weight) if weight else F.count(F.lit(1))).over(series)
    cols.update({name: F.lag(F.col(f"`{c}`")).over(along) for name, c in before.items()})
    cols.update({name: F.lead(F.col(f"`{c}`")).over(along) for name, c in after.items()})
    return df.withColumns(cols)


def with_position(
    df: DataFrame,
    order_by: str,
    keys: Sequence[str] = (),
    name: str = "pos",
    total: str | None = None,
    prof: Profile | None = None,
) -> DataFrame:
    """0-based position of every row in time order within its series."""
    return place(df, order_by, keys, start=name, total=total, prof=prof)


def over_blocks(
    df: DataFrame,
    order_by: str,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    *,
    reach_back: int = 0,
    reach_ahead: int = 0,
    keys: Sequence[str] = (),
    prof: Profile | None = None,
    position: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Evaluate window columns whose frames reach a fixed number of rows.

    ``columns`` receives the window (partitioned and ordered) and returns the new
    columns. Long series are cut into blocks of positions; each block also gets
    the ``reach_back`` rows ahead of it and the ``reach_ahead`` rows behind it.
    ``position`` names a column that holds the positions already.
    """
    prof = prof or profile(df, order_by, keys)
    if prof.plain:
        return df.withColumns(dict(columns(Window.partitionBy(*keys).orderBy(*total_order(df, order_by)))))
    size = max(block_rows or BLOCK_ROWS, reach_back, reach_ahead, 1)
    if position:
        placed = df.withColumn("__pos", F.col(position))
    else:
        placed = with_position(df, order_by, keys, "__pos", prof=prof)
    block = F.expr(f"__pos div {size}")
    within = F.col("__pos") % size
    copies = [F.struct(block.alias("id"), F.lit(True).alias("own"))]
    if reach_back:
        copies.append(F.when(within >= size - reach_back, F.struct((block + 1).alias("id"), F.lit(False).alias("own"))))
    if reach_ahead:
        copies.append(
            F.when((within < reach_ahead) & (block > 0), F.struct((block - 1).alias("id"), F.lit(False).alias("own")))
        )
    spread = placed.withColumn("__copy", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())))
    spread = spread.withColumn("__blk", F.col("__copy.id"))
    window = Window.partitionBy(*keys, "__blk").orderBy("__pos")
    return (
        spread.withColumns(dict(columns(window)))
        .filter(F.col("__copy.own"))
        .drop("__copy", "__blk", "__pos")
    )


def attach(df: DataFrame, per_series: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add columns of a table that has one row per series.

    Without keys that row is a scalar subquery; with keys it is an equi-join, which
    Spark broadcasts only while the table is small and otherwise runs with its own
    skew handling.
    """
    if not keys:
        one = per_series.select(F.struct(*names)).scalar()
        held = df.withColumn("__s", one)
        return held.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("__s")[n].alias(n) for n in names])
    right = per_series.select(F.struct(*keys).alias("__gk"), *names)
    joined = df.withColumn("__jk", F.struct(*keys)).join(right, F.col("__jk") == F.col("__gk"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *names)


def with_group_stats(df: DataFrame, stats: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Attach aggregates of each series to its rows."""
    return attach(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), list(stats), keys)
