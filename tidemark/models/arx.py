"""Regression with ARIMA errors by two-stage least squares (Hannan and Rissanen 1982).

1. Difference target and regressors ``d`` times, regress one on the other (Spark ML).
2. A long autoregression of the residual, from its autocorrelations, gives innovations.
3. The ARMA part is least squares of the residual on its lags and lagged innovations:
   one cross-product matrix over the data serves every order (p, q).
4. The forecast of the error part is a linear recursion in the horizon alone. Its state
   at any horizon is a matrix power, so all rows are predicted in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import Profile, over_blocks, profile
from ..operators.split import chronological_split
from ..operators.timestats import acf
from ..schema import FEATURES, TARGET
from ..session import cut_lineage
from .base import Evaluation, Forecaster, evaluate
from .registry import best_params

# Largest modulus of the autoregressive part; beyond it a long forecast would explode.
MAX_MODULUS = 0.999
# Impulse responses that are computed at once.
RESPONSES = 1024


def difference_weights(d: int) -> list[float]:
    """Coefficients of (1 - B)^d."""
    return [float((-1) ** i * math.comb(d, i)) for i in range(d + 1)]


def solve_toeplitz(r: np.ndarray) -> np.ndarray:
    """Yule-Walker coefficients from autocorrelations ``r[0..m]``."""
    m = len(r) - 1
    if m == 0:
        return np.zeros(0)
    lags = np.abs(np.subtract.outer(np.arange(m), np.arange(m)))
    return np.linalg.lstsq(r[lags], r[1:], rcond=None)[0]


def stable(phi: np.ndarray) -> np.ndarray:
    """Pull the roots of the autoregression inside the unit circle if they are not."""
    if len(phi) == 0:
        return phi
    companion = np.vstack([phi, np.eye(len(phi))[:-1]])
    top = np.abs(np.linalg.eigvals(companion)).max()
    if top <= MAX_MODULUS:
        return phi
    return phi * (MAX_MODULUS / top) ** np.arange(1, len(phi) + 1)


@dataclass
class ErrorModel:
    """ARIMA(p, d, q) of the regression error with its state at the end of the train rows.

    The state holds the last p differenced errors, q innovations, d undifferenced
    levels (newest first) and the constant 1.
    """

    phi: list[float]
    theta: list[float]
    d: int
    drift: float
    sigma: float
    state: list[float]

    def system(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Transition, output row and innovation input of one step."""
        p, q, d = len(self.phi), len(self.theta), self.d
        size = p + q + d + 1
        eta = np.zeros(size)
        eta[:p], eta[p : p + q] = self.phi, self.theta
        level = eta.copy()
        level[-1] += self.drift
        level[p + q : p + q + d] = [-w for w in difference_weights(d)[1:]]
        step = np.zeros((size, size))
        enters = np.zeros(size)
        if p:
            step[0], enters[0] = eta, 1.0
            step[np.arange(1, p), np.arange(p - 1)] = 1.0
        if q:
            step[np.arange(p + 1, p + q), np.arange(p, p + q - 1)] = 1.0
            enters[p] = 1.0
        if d:
            step[p + q], enters[p + q] = level, 1.0
            step[np.arange(p + q + 1, p + q + d), np.arange(p + q, p + q + d - 1)] = 1.0
        step[-1, -1] = 1.0
        return step, level, enters

    def forecast(self, horizon: np.ndarray) -> np.ndarray:
        """Error forecast for horizons >= 1 in any order."""
        step, level, _ = self.system()
        wanted, back = np.unique(np.asarray(horizon, dtype=np.int64), return_inverse=True)
        out = np.empty(len(wanted))
        for begin, end, at, columns in _blocks(step, np.asarray(self.state, dtype=float), wanted):
            out[begin:end] = (level @ columns)[wanted[begin:end] - at]
        return out[back]

    def variance(self, horizon: np.ndarray) -> np.ndarray:
        """Forecast variance for horizons >= 1: sigma^2 times the sum of squared impulse responses."""
        step, level, enters = self.system()
        wanted, back = np.unique(np.asarray(horizon, dtype=np.int64), return_inverse=True)
        out, reached, spread = np.empty(len(wanted)), 1, 1.0
        for begin, end, at, columns in _blocks(step, enters, wanted):
            if at > reached:
                cover = self._advance(step, enters, np.zeros(step.shape), at - 1)
                spread = 1.0 + float(level @ cover @ level)
            totals = spread + np.concatenate([[0.0], np.cumsum((level @ columns) ** 2)])
            out[begin:end] = totals[wanted[begin:end] - at]
            reached, spread = at + columns.shape[1], totals[-1]
        return self.sigma**2 * out[back]

    @staticmethod
    def _advance(step, enters, cover, count):
        """``count`` covariance steps by doubling."""
        power, gain = step, np.outer(enters, enters)
        while count:
            if count & 1:
                cover = power @ cover @ power.T + gain
            gain = power @ gain @ power.T + gain
            power, count = power @ power, count >> 1
        return cover


def _krylov(step: np.ndarray, state: np.ndarray, count: int) -> np.ndarray:
    """Columns state, step @ state, … , doubled until there are ``count``."""
    columns = state[:, None]
    while columns.shape[1] < count:
        columns = np.concatenate([columns, step @ columns], axis=1)
        step = step @ step
    return columns[:, :count]


def _blocks(step: np.ndarray, state: np.ndarray, wanted: np.ndarray):
    """The states at sorted horizons, RESPONSES steps at once.

    Yields the range of ``wanted`` that a block covers, the block's first horizon and its
    states as columns. Gaps are crossed by a matrix power.
    """
    begin, at = 0, 1
    while begin < len(wanted):
        if wanted[begin] >= at + RESPONSES:
            state = np.linalg.matrix_power(step, int(wanted[begin] - at)) @ state
            at = int(wanted[begin])
        columns = _krylov(step, state, RESPONSES)
        end = int(np.searchsorted(wanted, at + RESPONSES))
        yield begin, end, at, columns
        begin, at, state = end, at + RESPONSES, step @ columns[:, -1]


class ArxForecaster(Forecaster):
    """Linear regression plus the forecast of its error; rows need their position ``pos``."""

    kind = "arx"

    def __init__(self, features: Sequence[str], beta: list[float], intercept: float, train_rows: int, error: ErrorModel):
        self.features, self.beta, self.intercept = list(features), beta, intercept
        self.train_rows, self.error = train_rows, error

    def _regression(self) -> Column:
        parts = (F.col(f) * F.lit(b) for f, b in zip(self.features, self.beta))
        return sum(parts, F.lit(self.intercept))

    def _horizon(self) -> Column:
        return F.col("pos") - F.lit(self.train_rows - 1)

    def _by_horizon(self, name: str) -> Column:
        error = self.error

        @F.pandas_udf("double")
        def value(h: pd.Series) -> pd.Series:
            return pd.Series(getattr(error, name)(h.to_numpy(dtype="int64")))

        return value(F.greatest(self._horizon(), F.lit(1)))

    def transform(self, df: DataFrame) -> DataFrame:
        made = self._regression() + self._by_horizon("forecast")
        return df.withColumn("prediction", F.when(self._horizon() >= 1, made))

    def interval(self, df: DataFrame, z: float = 1.959963984540054) -> DataFrame:
        """``prediction, lower, upper`` for the rows after the train rows."""
        wide = self.transform(df.filter(self._horizon() >= 1)).withColumn("__sd", F.sqrt(self._by_horizon("variance")))
        return wide.withColumns(
            {"lower": F.col("prediction") - z * F.col("__sd"), "upper": F.col("prediction") + z * F.col("__sd")}
        ).drop("__sd")

    def meta(self) -> dict:
        return {
            "features": self.features, "beta": self.beta, "intercept": self.intercept,
            "train_rows": self.train_rows, "error": vars(self.error),
        }

    @classmethod
    def restore(cls, meta, parts):
        return cls(**{**meta, "error": ErrorModel(**meta["error"])})


@dataclass
class _Stage:
    """What all orders with the same ``d`` share."""

    beta: list[float]
    intercept: float
    gram: np.ndarray
    max_p: int
    max_q: int
    rows: int
    recent: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: list[float] = field(default_factory=list)
    long_ar: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _differenced(train: DataFrame, time_col: str, columns: Sequence[str], d: int, prof: Profile) -> DataFrame:
    if d == 0:
        return train
    weights = difference_weights(d)

    def lagged(w):
        return {
            f"__d_{c}": sum((F.lag(c, i).over(w) * k for i, k in enumerate(weights) if i), F.col(c) * weights[0])
            for c in columns
        }

    wide = over_blocks(train, time_col, lagged, reach_back=d, prof=prof)
    kept = wide.filter(F.col(f"__d_{columns[0]}").isNotNull())
    return kept.drop(*columns).withColumnsRenamed({f"__d_{c}": c for c in columns})


def _long_order(n: int, p: int, q: int) -> int:
    return min(max(p + q, int(round(math.log(max(n, 2)) ** 1.5))), max(n // 4, 1))


def _cross_products(long_ar: np.ndarray, p: int, q: int):
    """Partition function: sums of products of (eta, eta lags, innovation lags), one row per task."""
    reach = len(long_ar)

    def run(batches):
        total, n = np.zeros((p + q + 1, p + q + 1)), 0
        for pdf in batches:
            if not len(pdf):
                continue
            eta = np.stack(pdf["history"].to_numpy())[:, ::-1]  # newest first
            cols = [eta[:, 0], *[eta[:, j] for j in range(1, p + 1)]]
            for j in range(1, q + 1):
                cols.append(eta[:, j] - eta[:, j + 1 : j + 1 + reach] @ long_ar)
            rows = np.column_stack(cols)
            total += rows.T @ rows
            n += len(rows)
        yield pd.DataFrame({"cells": [np.append(total.ravel(), n)]})

    return run


def _fit_stage(
    train: DataFrame, time_col: str, features: Sequence[str], target: str, d: int, max_p: int, max_q: int, prof: Profile
) -> _Stage:
    columns = [target, *features]
    rows = _differenced(train.select(time_col, *columns), time_col, columns, d, prof)
    vectors = VectorAssembler(inputCols=list(features), outputCol="__x").transform(rows)
    ols = LinearRegression(featuresCol="__x", labelCol=target, solver="normal", regParam=0.0).fit(vectors)
    beta, intercept = [float(b) for b in ols.coefficients], float(ols.intercept)
    fitted = sum((F.col(f) * F.lit(b) for f, b in zip(features, beta)), F.lit(0.0))
    eta = rows.select(time_col, (F.col(target) - fitted - F.lit(intercept)).alias("__eta"))
    n = ols.summary.numInstances
    reach = _long_order(n, max_p, max_q) if max_q else 0
    long_ar = np.zeros(0)
    if reach:
        # reach + 1 numbers.
        r = [row["acf"] for row in acf(eta, "__eta", time_col, reach, prof=prof).orderBy("lag").collect()]
        long_ar = solve_toeplitz(np.asarray([v or 0.0 for v in r], dtype=float))
    depth = max(max_p, max_q + len(long_ar)) + 1
    histories = over_blocks(
        eta,
        time_col,
        lambda w: {"history": F.collect_list("__eta").over(w.rowsBetween(-(depth - 1), 0))},
        reach_back=depth - 1,
        prof=prof,
    ).filter(F.size("history") == depth)
    partials = histories.select("history").mapInPandas(_cross_products(long_ar, max_p, max_q), "cells array<double>")
    width = max_p + max_q + 1
    sums = partials.select(F.posexplode("cells").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    gram = np.zeros(width * width + 1)
    for row in sums:  # (max_p + max_q + 1)^2 numbers and the number of rows
        gram[row["i"]] = row["v"]
    gram, used = gram[:-1], int(gram[-1])
    recent = eta.orderBy(F.col(time_col).desc()).limit(depth).collect()
    undiff = train.select(time_col, (F.col(target) - fitted).alias("v")).orderBy(F.col(time_col).desc()).limit(d).collect()
    return _Stage(
        beta, intercept, gram.reshape(width, width), max_p, max_q, used,
        np.asarray([row["__eta"] for row in recent], dtype=float), [float(row["v"]) for row in undiff], long_ar,
    )


def _fit_order(stage: _Stage, p: int, d: int, q: int) -> ErrorModel:
    """Least squares of one order from the shared cross products."""
    cols = [*range(1, p + 1), *range(stage.max_p + 1, stage.max_p + 1 + q)]
    gram = stage.gram
    coef = np.linalg.lstsq(gram[np.ix_(cols, cols)], gram[cols, 0], rcond=None)[0] if cols else np.zeros(0)
    phi, theta = stable(coef[:p]), coef[p:]
    ssr = max(gram[0, 0] - (coef @ gram[cols, 0] if cols else 0.0), 0.0)
    sigma = math.sqrt(ssr / stage.rows) if stage.rows else 0.0
    eta, reach = stage.recent, len(stage.long_ar)
    past = [float(eta[i]) if i < len(eta) else 0.0 for i in range(p)]
    shocks = [
        float(eta[j] - eta[j + 1 : j + 1 + reach] @ stage.long_ar) if j + 1 + reach <= len(eta) else 0.0 for j in range(q)
    ]
    return ErrorModel(
        [float(v) for v in phi], [float(v) for v in theta], d, stage.intercept if d else 0.0, sigma,
        [*past, *shocks, *stage.levels[:d], 1.0],
    )


def fit_arx(
    train: DataFrame,
    time_col: str,
    order: tuple[int, int, int],
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    train_rows: int | None = None,
    prof: Profile | None = None,
) -> ArxForecaster:
    """Fit one order on the train rows."""
    p, d, q = order
    prof = prof or profile(train, time_col)
    stage = _fit_stage(train, time_col, features, target, d, p, q, prof)
    rows = train_rows if train_rows is not None else prof.rows
    return ArxForecaster(features, stage.beta, 0.0 if d else stage.intercept, rows, _fit_order(stage, p, d, q))


def arx_forecast(
    df: DataFrame,
    freq: str,
    time_col: str,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    order: tuple[int, int, int] | None = None,
) -> Evaluation:
    """Fit on train, forecast validation and test in one run from the end of train, score both.

    The principal components of the features add nothing to the space the features
    and the constant span, so the regression uses the features themselves.
    """
    order = tuple(order or best_params("sarimax", freq)["order"])
    narrow = df.select(time_col, target, *features)
    prof = profile(narrow, time_col)
    split = cut_lineage(chronological_split(narrow, time_col, prof=prof))
    train = split.filter(F.col("split") == "train")
    model = fit_arx(train, time_col, order, features, target, int(prof.rows * 0.6), prof)
    return evaluate(model, split, time_col, "sarimax", freq, target, prof)


def _candidate_errors(models: list[ErrorModel]):
    """Partition function: summed absolute error of every candidate, one row per task."""

    def run(batches):
        total, n = np.zeros(len(models)), 0
        for pdf in batches:
            h, left = pdf["h"].to_numpy(), pdf["left"].to_numpy(dtype=float)
            with np.errstate(over="ignore", invalid="ignore"):
                total += [np.abs(left - m.forecast(h)).sum() if len(h) else 0.0 for m in models]
            n += len(pdf)
        yield pd.DataFrame({"errors": [total], "n": [n]})

    return run


def order_grid_search(
    df: DataFrame,
    time_col: str,
    max_p: int = 7,
    max_d: int = 5,
    max_q: int = 7,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
) -> DataFrame:
    """``p, d, q, MAE`` on the validation rows for every order, best first.

    For each ``d`` all orders share the regression, the cross products and one pass
    over the validation rows. Orders whose forecast overflows get a null score.
    """
    narrow = df.select(time_col, target, *features)
    prof = profile(narrow, time_col)
    split = cut_lineage(chronological_split(narrow, time_col, prof=prof))
    train = split.filter(F.col("split") == "train")
    held = split.filter(F.col("split") == "validation")
    train_rows, found = int(prof.rows * 0.6), []
    for d in range(max_d + 1):
        stage = _fit_stage(train, time_col, features, target, d, max_p, max_q, prof)
        orders = [(p, q) for p in range(max_p + 1) for q in range(max_q + 1)]
        models = [_fit_order(stage, p, d, q) for p, q in orders]
        base = sum((F.col(f) * F.lit(b) for f, b in zip(features, stage.beta)), F.lit(0.0 if d else stage.intercept))
        rows = held.select((F.col("pos") - (train_rows - 1)).alias("h"), (F.col(target) - base).alias("left"))
        errors = rows.mapInPandas(_candidate_errors(models), "errors array<double>, n long")
        summed = errors.select("n", F.posexplode("errors").alias("i", "e")).groupBy("i").agg(
            (F.sum("e") / F.sum("n")).alias("mae")
        )
        for row in summed.collect():  # one number per order
            p, q = orders[row["i"]]
            value = row["mae"]
            found.append((p, d, q, value if value is not None and math.isfinite(value) else None))
    table = df.sparkSession.createDataFrame(found, "p int, d int, q int, MAE double")
    return table.orderBy(F.asc_nulls_last("MAE"), "p", "d", "q")
