"""Autocorrelation, partial autocorrelation, augmented Dickey-Fuller test, seasonality report."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ordered
from .ordered import Profile, longest_series, over_blocks, profile, with_group_stats, with_position
from .resample import as_frequency
from .sequence import seasonal_decompose

# Rows that one correlation of the unit root test covers.
ADF_BLOCK = 1 << 14

# Two-sided 95 % and 99 % points of the normal distribution.
Z95 = 1.959963984540054
Z99 = 2.5758293035489004

# Fixed values (MacKinnon 2010, one variable, constant): critical value = b0 + b1/T + b2/T^2 + b3/T^3.
ADF_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
# Fixed values (MacKinnon 1994): p = Phi(polynomial in the statistic), lowest power first.
ADF_P_SMALL = (2.1659, 1.4412, 0.038269)
ADF_P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_P_SWITCH, ADF_P_MIN, ADF_P_MAX = -1.61, -18.83, 2.74


def acf(
    df: DataFrame,
    column: str,
    time_col: str,
    max_lag: int = 40,
    keys: Sequence[str] = (),
    prof: Profile | None = None,
) -> DataFrame:
    """Autocorrelation for lags 0..``max_lag`` with 95 % and 99 % bands; nulls are dropped."""
    value = F.col(f"`{column}`").cast("double")
    df = df.filter(value.isNotNull())
    centred = with_group_stats(df.select(*keys, time_col, value.alias("__v")), {"__mean": F.avg("__v")}, keys)
    centred = centred.select(*keys, time_col, (F.col("__v") - F.col("__mean")).alias("__x"))
    x = F.col("__x")
    leads = over_blocks(
        centred,
        time_col,
        lambda w: {f"__l{h}": F.lead(x, h).over(w) for h in range(1, max_lag + 1)},
        reach_ahead=max_lag,
        keys=keys,
        prof=prof,
    )
    sums = [F.sum(x * x).alias("__s0"), F.count(x).alias("__n")]
    sums += [F.sum(x * F.col(f"__l{h}")).alias(f"__s{h}") for h in range(1, max_lag + 1)]
    total = leads.groupBy(*keys).agg(*sums)
    cells = [
        F.struct(
            F.lit(h).cast("bigint").alias("lag"), F.try_divide(F.coalesce(f"__s{h}", F.lit(0.0)), F.col("__s0")).alias("acf")
        )
        for h in range(max_lag + 1)
    ]
    long = total.select(*keys, "__n", F.explode(F.array(*cells)).alias("__cell"))
    return long.filter(F.col("__cell.lag") < F.col("__n")).select(
        *keys,
        "__cell.*",
        (Z95 / F.sqrt(F.col("__n"))).alias("band95"),
        (Z99 / F.sqrt(F.col("__n"))).alias("band99"),
    )


def levinson_durbin(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations ``r[0..m]``."""
    out, phi = [1.0], np.zeros(0)
    for k in range(1, len(r)):
        spread = 1.0 - phi @ r[1:k]
        if not np.isfinite(spread) or abs(spread) < 1e-15:
            out.extend([np.nan] * (len(r) - k))
            break
        last = (r[k] - phi @ r[1:k][::-1]) / spread
        phi = np.append(phi - last * phi[::-1], last)
        out.append(last)
    return np.asarray(out)


def pacf(
    df: DataFrame,
    column: str,
    time_col: str,
    max_lag: int = 40,
    keys: Sequence[str] = (),
    prof: Profile | None = None,
) -> DataFrame:
    """Partial autocorrelation for lags 0..``max_lag`` (Yule-Walker)."""
    table = acf(df, column, time_col, max_lag, keys, prof)
    # One array of max_lag + 1 numbers per series.
    rows = table.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("__r"))

    @F.pandas_udf("array<double>")
    def solve(lags: pd.Series) -> pd.Series:
        return lags.map(lambda r: levinson_durbin(np.asarray(r, dtype=float)))

    solved = rows.select(*keys, F.posexplode(solve(F.transform("__r", lambda c: c["acf"]))).alias("lag", "pacf"))
    return solved.select(*keys, F.col("lag").cast("bigint").alias("lag"), F.nanvl("pacf", F.lit(None).cast("double")).alias("pacf"))


def adf_p_value(stat: float) -> float:
    if stat > ADF_P_MAX:
        return 1.0
    if stat < ADF_P_MIN:
        return 0.0
    coefs = ADF_P_SMALL if stat <= ADF_P_SWITCH else ADF_P_LARGE
    return 0.5 * (1.0 + math.erf(sum(c * stat**i for i, c in enumerate(coefs)) / math.sqrt(2.0)))


def adf_max_lag(n: int) -> int:
    """Largest lag tried for a series of ``n`` values."""
    return max(0, min(n // 2 - 2, math.ceil(12.0 * (n / 100.0) ** 0.25)))


def _adf_gram(sums: dict, head: np.ndarray, tail: np.ndarray, n: int, lags: int) -> tuple[np.ndarray, int]:
    """Cross products of ``level, 1, difference lags 1..lags, difference`` over the rows lags+1 .. n-1.

    Sums over the whole series minus the terms at both ends that these rows leave out.
    """
    first = np.diff(head)  # first[s - 1] is the difference at position s
    final = np.diff(tail)[::-1]  # final[k] is the difference at position n - 1 - k
    end, size = tail[-1], lags + 3
    # Place of each regressor: 0 level, 1 constant, 2..lags+1 lagged differences, lags+2 difference.
    places = [lags + 2, *range(2, lags + 2)]
    gram = np.zeros((size, size))
    gram[1, 1] = rows = n - 1 - lags
    gram[0, 1] = sums["x"] - head[:lags].sum() - end
    gram[0, 0] = sums["xx"] - head[:lags] @ head[:lags] - end**2
    # level(t-1) * difference(t-j) from running sums of difference(s) * x(s+j-1).
    run = sums["dx"]
    gram[0, lags + 2] = run - sums["d"][0] - first[:lags] @ head[:lags]
    for j, at in enumerate(places):
        left = lags - j
        # The sum of the differences telescopes.
        gram[1, at] = tail[-1 - j] - head[left]
        if j:
            if j > 1:
                run = run - final[j - 2] * end + sums["d"][j - 1]
            gram[0, at] = run - first[:left] @ head[j : j + left] - final[j - 1] * end
        for i in range(j + 1):
            h = j - i
            inner = sums["d"][h] - first[:left] @ first[h : h + left] - final[h:j] @ final[: j - h]
            gram[places[i], at] = gram[at, places[i]] = inner
    gram[:, 0], gram[1:, 1] = gram[0], gram[1, 1:]
    return gram, rows


def _adf_parts(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled regressor products, scaled products with the difference, and the scale."""
    diagonal = np.diag(gram)[:-1]
    scale = 1.0 / np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    return gram[:-1, :-1] * np.outer(scale, scale), gram[:-1, -1] * scale, scale


def _adf_squares(gram: np.ndarray) -> np.ndarray:
    """Squared residuals of the nested regressions with 0, 1, … lagged differences."""
    products, with_step, _ = _adf_parts(gram)
    try:
        # One factorisation serves all: each column adds its own explained square.
        explained = np.cumsum(np.linalg.solve(np.linalg.cholesky(products), with_step) ** 2)
        return gram[-1, -1] - explained[1:]
    except np.linalg.LinAlgError:
        left = []
        for k in range(2, len(products) + 1):
            beta = np.linalg.pinv(products[:k, :k], hermitian=True) @ with_step[:k]
            left.append(gram[-1, -1] - beta @ with_step[:k])
        return np.asarray(left)


def adf_solve(sums: dict, head: np.ndarray, tail: np.ndarray, n: int, max_lag: int) -> tuple[float, int, int]:
    """Lag by AIC on the common sample, then the t-ratio on the own sample of that lag."""
    gram, rows = _adf_gram(sums, head, tail, n, max_lag)
    squares = _adf_squares(gram)
    lags = np.arange(max_lag + 1)
    usable = (squares > 1e-14 * gram[-1, -1]) & (rows > lags + 2)
    if not usable.any():
        return math.nan, 0, n - 1
    with np.errstate(invalid="ignore", divide="ignore"):
        aic = np.where(usable, rows * np.log(squares / rows) + 2 * (lags + 2), np.inf)
    best = int(np.argmin(aic))
    own, rows = _adf_gram(sums, head, tail, n, best)
    products, with_step, scale = _adf_parts(own)
    inverse = np.linalg.pinv(products, hermitian=True)
    beta = inverse @ with_step
    left, free = own[-1, -1] - beta @ with_step, rows - len(with_step)
    if free <= 0 or left <= 1e-14 * own[-1, -1] or inverse[0, 0] <= 0:
        return math.nan, best, rows
    return beta[0] / math.sqrt(left / free * inverse[0, 0]), best, rows


def _block_starts(batch: pa.RecordBatch) -> np.ndarray:
    """First row of every block in rows sorted by series, block and position.

    Positions of a block follow each other, and no block of another series begins where
    one with the same number ends.
    """
    t, b = (batch.column(name).to_numpy() for name in ("__t", "__b"))
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1] + 1) | (b[1:] != b[:-1])
    return np.flatnonzero(new)


def _block_products(batch: pa.RecordBatch, keys: Sequence[str], size: int, limit: int) -> pa.RecordBatch:
    """(keys, kind, i, v) of all blocks of a batch at once: sums and lagged products, heads, tails, lengths."""
    starts = _block_starts(batch)
    t, n, x, b = (batch.column(name).to_numpy() for name in ("__t", "__n", "__x", "__b"))
    own = (t >= b * size) & (t < (b + 1) * size)
    # step[i] leads to row i; the first row of a block has none.
    step = np.diff(x, prepend=x[:1])
    step[starts] = 0.0
    number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
    mine, kept = np.where(own, step, 0.0), np.where(own, x, 0.0)
    add = lambda v: np.add.reduceat(v, starts)
    sums = [add(kept), add(kept * kept), add(mine * x)]
    for h in range(limit + 1):
        lagged = np.zeros(len(t))
        if h < len(t):
            lagged[: len(t) - h] = np.where(number[h:] == number[: len(t) - h], mine[: len(t) - h] * step[h:], 0.0)
        sums.append(add(lagged))
    # Blocks whose own rows are none hold a copy alone and tell zeros.
    head, tail = np.flatnonzero(own & (t <= limit + 1)), np.flatnonzero(own & (t >= n - limit - 2))
    begin = np.flatnonzero(own & (t == 0))
    width = len(sums)
    rows = np.concatenate([np.repeat(starts, width), head, tail, begin])
    kinds = np.repeat(np.arange(4, dtype=np.int32), [width * len(starts), len(head), len(tail), len(begin)])
    places = np.concatenate([np.tile(np.arange(width), len(starts)), t[head], t[tail], np.zeros(len(begin), np.int64)])
    values = np.concatenate([np.stack(sums, axis=1).ravel(), x[head], x[tail], n[begin].astype(float)])
    told = [batch.column(k).take(pa.array(rows)) for k in keys]
    return pa.RecordBatch.from_arrays([*told, pa.array(kinds), pa.array(places, pa.int64()), pa.array(values)], [*keys, "kind", "i", "v"])


def adf_test(
    df: DataFrame,
    column: str,
    time_col: str,
    keys: Sequence[str] = (),
    max_lag: int | None = None,
    prof: Profile | None = None,
) -> DataFrame:
    """Augmented Dickey-Fuller test with constant and lag choice by AIC, one row per series.

    The regression matrix is made of lagged products of the differences. Blocks of
    positions, with copies of the rows behind them, yield these products, all blocks of an
    Arrow batch by one pass a lag; Spark adds them up with the first and last values of each series,
    and the small solve runs per series; the plan is the same for any number of lags.
    ``max_lag`` limits the lags tried; the length of a series limits them too. Nulls are
    dropped.
    """
    df = df.filter(F.col(f"`{column}`").isNotNull())
    prof = prof or profile(df, time_col, keys)
    limit = adf_max_lag(longest_series(df, keys) if keys else prof.rows)
    limit = limit if max_lag is None else min(limit, max_lag)
    value = F.col(f"`{column}`").cast("double")
    base = with_group_stats(df.select(*keys, time_col, value.alias("__v")), {"__mean": F.avg("__v")}, keys)
    base = base.select(*keys, time_col, (F.col("__v") - F.col("__mean")).alias("__x"))
    placed = with_position(base, time_col, keys, "__t", total="__n", prof=prof)
    size = max(min(ADF_BLOCK, ordered.BLOCK_ROWS), limit + 1)
    block, within = F.expr(f"__t div {size}"), F.col("__t") % size
    copies = F.array(block, F.when(within == size - 1, block + 1), F.when((within < limit) & (block > 0), block - 1))
    spread = placed.select(*keys, "__t", "__n", "__x", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("__b"))
    cell = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("i", T.LongType()), T.StructField("v", T.DoubleType())])
    cells_schema = T.StructType([*(df.schema[k] for k in keys), *cell])

    def products(batches):
        pending = None
        for batch in batches:
            batch = batch if pending is None else pa.concat_batches([pending, batch])
            cut = _block_starts(batch)[-1:].sum()
            # The last block may go on in the next batch.
            pending = batch.slice(cut)
            if cut:
                yield _block_products(batch.slice(0, cut), keys, size, limit)
        if pending is not None and pending.num_rows:
            yield _block_products(pending, keys, size, limit)

    dealt = spread.repartition(*keys, "__b").sortWithinPartitions(*keys, "__b", "__t")
    parts = dealt.mapInArrow(products, cells_schema)
    # Every head, tail and length is told once, so that all can be summed.
    sums = parts.groupBy(*keys, "kind", "i").agg(F.sum("v").alias("v"))
    ready = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("kind", "i", "v"))).alias("cells"))
    ready = ready.filter(F.size("cells") > 0)
    values = lambda kind: F.transform(F.filter("cells", lambda c: c["kind"] == kind), lambda c: c["v"])
    ready = ready.select(*keys, *[values(i).alias(n) for i, n in enumerate(("sums", "head", "tail", "n"))])
    if keys:
        # Many short rows: spread the solves, whose cost the byte size does not show.
        ready = ready.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    names = ["statistic", "p_value", "critical_1", "critical_5", "critical_10"]
    out_schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField(n, T.DoubleType()) for n in names]
        + [T.StructField("used_lag", T.LongType()), T.StructField("n_obs", T.LongType()), T.StructField("verdict", T.StringType())]
    )

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                size = int(r.n[0])
                stat, lag, n = math.nan, 0, size - 1
                if size >= 4:
                    found = {"x": r.sums[0], "xx": r.sums[1], "dx": r.sums[2], "d": r.sums[3:]}
                    tried = min(limit, adf_max_lag(size))
                    stat, lag, n = adf_solve(found, np.asarray(r.head), np.asarray(r.tail), size, tried)
                p = adf_p_value(stat) if math.isfinite(stat) else None
                crit = [sum(c / n**i for i, c in enumerate(b)) if n else None for b in ADF_CRITICAL.values()]
                verdict = None if p is None else ("Stationary" if p < 0.05 else "Non-Stationary")
                rows.append([*[getattr(r, k) for k in keys], stat if p is not None else None, p, *crit, lag, n, verdict])
            yield pd.DataFrame(rows, columns=out_schema.names)

    return ready.mapInPandas(solve, out_schema)


def seasonality_trend_report(
    df: DataFrame,
    column: str,
    time_col: str,
    freq: str = "H",
    period: int = 24,
) -> DataFrame:
    """Regular grid, nulls dropped, ADF verdict and the strength of the decomposed parts in one row."""
    grid = as_frequency(df.select(time_col, column), time_col, freq)
    series = grid.filter(F.col(f"`{column}`").isNotNull())
    prof = profile(series, time_col)
    adf = adf_test(series, column, time_col, prof=prof)
    parts = seasonal_decompose(series, column, time_col, period, prof=prof).agg(
        F.struct(
            F.var_pop("trend").alias("trend"), F.var_pop("seasonal").alias("seasonal"), F.var_pop("resid").alias("resid")
        )
    ).scalar()
    return adf.withColumn("__parts", parts).select(
        "statistic", "p_value", "used_lag", "n_obs", "critical_1", "critical_5", "critical_10", "verdict",
        F.col("__parts.trend").alias("trend_variance"),
        F.col("__parts.seasonal").alias("seasonal_variance"),
        F.col("__parts.resid").alias("resid_variance"),
    )
