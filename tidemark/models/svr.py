"""Support-vector regression in the primal by reweighted least squares.

The penalty C * max(0, |y - f(x)| - epsilon) is majorised at the current fit by a
weighted square with weight C / |y - f(x)| outside the tube and 0 inside (Perez-Cruz
et al. 2000), so every step is one weighted ridge regression, scaled as Spark ML does it.
Its sums are made by one pass over the rows, the step length is chosen from one more; all
models of a call share these passes, so that a search takes no more of them than its
slowest model. The rbf kernel uses random Fourier features (Rahimi and Recht 2007), the
polynomial kernel an expansion.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import feature_stages
from .base import Forecaster
from .shards import ROWS_PER_TASK, affine_of

# Width over which the penalty is smoothed at the edge of the tube, as a share of the label's deviation.
EDGE = 1e-3
STEPS = (1.0, 0.5, 0.25, 0.1)


def fourier_map(size: int, count: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of ``count`` random features for exp(-gamma |x - x'|^2)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, math.sqrt(2.0 * gamma), (count, size)), rng.uniform(0.0, 2.0 * math.pi, count)


def _expand(df: DataFrame, kernel: str, size: int, gamma: float, count: int, seed: int) -> DataFrame:
    """Add ``z``, the features in which the model is linear."""
    if kernel == "linear":
        return df.withColumn("z", F.col("features"))
    if kernel == "poly":
        # (gamma x.x')^3 in the primal: monomials of gamma^(1/2) x.
        scaled = F.transform(vector_to_array("features"), lambda v: v * math.sqrt(gamma))
        return PolynomialExpansion(degree=3, inputCol="__g", outputCol="z").transform(
            df.withColumn("__g", array_to_vector(scaled))
        ).drop("__g")
    if kernel != "rbf":
        raise ValueError(f"unknown kernel {kernel!r}")
    omega, phase = fourier_map(size, count, gamma, seed)

    @F.pandas_udf("array<double>")
    def features(x: pd.Series) -> pd.Series:
        made = math.sqrt(2.0 / count) * np.cos(np.stack(x.to_numpy()) @ omega.T + phase)
        return pd.Series(list(made))

    return df.withColumn("z", array_to_vector(features(vector_to_array("features"))))


def _dot(z: Column, beta: Sequence[float], intercept: float) -> Column:
    terms = F.zip_with(z, F.array(*[F.lit(float(b)) for b in beta]), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(float(intercept)), lambda s, t: s + t)


class SvrForecaster(Forecaster):
    """Linear function of the (expanded) features."""

    kind = "svr"

    def __init__(self, prepare: PipelineModel, params: dict, beta: list[float], intercept: float):
        self.prepare, self.params, self.beta, self.intercept = prepare, params, beta, intercept

    def transform(self, df: DataFrame) -> DataFrame:
        made = _expand(self.prepare.transform(df), **self.params)
        return made.select(*df.columns, _dot(vector_to_array("z"), self.beta, self.intercept).alias("prediction"))

    def meta(self) -> dict:
        return {"params": self.params, "beta": self.beta, "intercept": self.intercept}

    def parts(self) -> list:
        return [self.prepare]

    @classmethod
    def restore(cls, meta, parts):
        return cls(parts[0], meta["params"], meta["beta"], meta["intercept"])


@dataclass(frozen=True)
class SvrParams:
    """Parameters of one model; an unknown kernel is an error."""

    C: float
    epsilon: float
    kernel: str
    gamma: float
    pca: float = 0.95
    components: int = 200
    max_iter: int = 25
    tolerance: float = 1e-5
    seed: int = 42

    def __post_init__(self):
        if self.kernel not in ("linear", "poly", "rbf"):
            raise ValueError(f"unknown kernel {self.kernel!r}")


@dataclass(frozen=True)
class SvrJob:
    """One model and the positions it learns from and is tested on (None: all rows, none)."""

    params: SvrParams
    train_end: int | None = None
    test_end: int | None = None


def _monomials(x: np.ndarray, degree: int = 3) -> np.ndarray:
    """The columns of Spark ML's ``PolynomialExpansion`` in its order."""
    ranks = itertools.product(range(degree + 1), repeat=x.shape[1])
    wanted = [r[::-1] for r in ranks if 0 < sum(r) <= degree]
    return np.stack([np.prod([x[:, i] ** e for i, e in enumerate(r) if e], axis=0) for r in wanted], axis=1)


class _Fit:
    """A model on its way: the map to its features, the best coefficients so far and the next ones to try."""

    def __init__(self, job: SvrJob, matrix: np.ndarray, offset: np.ndarray):
        self.job, self.matrix, self.offset = job, matrix, offset
        p, size = job.params, matrix.shape[1]
        self.fourier = fourier_map(size, p.components, p.gamma, p.seed) if p.kernel == "rbf" else None
        width = {"linear": size, "poly": math.comb(size + 3, 3) - 1, "rbf": p.components}[p.kernel]
        self.beta, self.intercept, self.edge, self.best = np.zeros(width), 0.0, 0.0, math.inf
        self.tried, self.steps = [], 0

    def z(self, x: np.ndarray) -> np.ndarray:
        p, made = self.job.params, x @ self.matrix + self.offset
        if p.kernel == "poly":
            return _monomials(made * math.sqrt(p.gamma))
        if p.kernel == "rbf":
            omega, phase = self.fourier
            return math.sqrt(2.0 / p.components) * np.cos(made @ omega.T + phase)
        return made

    def learns(self, pos: np.ndarray):
        return slice(None) if self.job.train_end is None else pos < self.job.train_end

    def losses(self, x, y, pos) -> np.ndarray:
        """Summed errors beyond the tube of all coefficients to try."""
        rows = self.learns(pos)
        z = self.z(x[rows])
        return np.array([np.maximum(np.abs(y[rows] - z @ b - c) - self.job.params.epsilon, 0.0).sum() for b, c in self.tried])

    def moments(self, x, y, pos) -> np.ndarray:
        """Weighted sums of the products of features, label and 1: the upper triangle, by rows."""
        p, rows = self.job.params, self.learns(pos)
        z = self.z(x[rows])
        miss = np.abs(y[rows] - z @ self.beta - self.intercept)
        outside = miss > p.epsilon
        a = p.C * np.minimum((miss[outside] - p.epsilon) / self.edge, 1.0) / miss[outside]
        every = np.column_stack([z[outside], y[rows][outside], np.ones(len(a))])
        return ((every * a[:, None]).T @ every)[np.triu_indices(every.shape[1])]

    def squares(self, x, y, pos) -> np.ndarray:
        """Squared error over the test rows, and their number."""
        held = (pos >= self.job.train_end) & (pos < self.job.test_end)
        miss = self.z(x[held]) @ self.beta + self.intercept - y[held]
        return np.array([np.square(miss).sum(), float(len(miss))])

    def aim(self, sums: np.ndarray) -> bool:
        """Set the steps towards the weighted ridge regression; False if no row lies outside the tube."""
        width = len(self.beta) + 2
        full = np.zeros((width, width))
        full[np.triu_indices(width)] = sums
        full = full + np.triu(full, 1).T
        mass = full[-1, -1]
        if not mass > 0.0:
            return False
        full /= mass
        goal, mean_y = np.zeros(width - 2), full[-2, -1]
        spread_y = math.sqrt(max(full[-2, -2] - mean_y * mean_y, 0.0))
        means = full[:-2, -1]
        spread = np.sqrt(np.maximum(np.diag(full)[:-2] - means * means, 0.0))
        used = np.flatnonzero(spread > 0)
        if spread_y > 0 and len(used):
            # Features and label by their deviations, as WeightedLeastSquares has them.
            at, size = np.append(used, width - 1), np.append(spread[used], 1.0)
            left = full[np.ix_(at, at)] / np.outer(size, size)
            left[np.arange(len(used)), np.arange(len(used))] += 1.0 / mass / spread_y / spread[used] ** 2
            right = full[at, -2] / size / spread_y
            try:
                np.linalg.cholesky(left)
                found = np.linalg.solve(left, right)
            except np.linalg.LinAlgError:
                found = np.linalg.lstsq(left, right, rcond=None)[0]
            goal[used] = found[:-1] * spread_y / spread[used]
        goal_c = mean_y - means @ goal
        self.tried = [(self.beta + s * (goal - self.beta), self.intercept + s * (goal_c - self.intercept)) for s in STEPS]
        return True

    def values(self, losses: np.ndarray) -> list[float]:
        return [0.5 * float(np.dot(b, b)) + self.job.params.C * float(s) for (b, _), s in zip(self.tried, losses)]

    def move(self, losses: np.ndarray) -> bool:
        """Take the best step; False if the search is over."""
        values = self.values(losses)
        at = int(np.argmin(values))
        if values[at] >= self.best:
            return False
        gain, self.best = self.best - values[at], values[at]
        self.beta, self.intercept = self.tried[at]
        self.steps += 1
        return gain > self.job.params.tolerance * max(self.best, 1e-12) and self.steps < self.job.params.max_iter


def _sums(rows: DataFrame, fits: dict[int, _Fit], what: str, groups: int) -> dict[int, np.ndarray]:
    """What the method gives for the rows of each batch, summed up by model.

    With several ``groups`` each task holds a copy of all rows and models are dealt out to them.
    """
    if not fits:
        return {}
    sent = rows.sparkSession.sparkContext.broadcast(fits)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        mine = list(sent.value.items())[TaskContext.get().partitionId() if groups > 1 else 0 :: groups]
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            for i, fit in mine:
                totals[i] = totals.get(i, 0.0) + getattr(fit, what)(x, y, pos)
        if totals:
            sums = pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), sums], ["model", "sums"])

    parts = rows.mapInArrow(run, "model int, sums array<double>").select("model", array_to_vector("sums").alias("sums"))
    made = parts.groupBy("model").agg(Summarizer.metrics("sum").summary(F.col("sums"))["sum"].alias("sums")).collect()
    sent.unpersist()
    return {r["model"]: r["sums"].toArray() for r in made}


def train_svr(train: DataFrame, features: Sequence[str], target: str, jobs: Sequence[SvrJob], order: str | None = None, rows_per_task: int = ROWS_PER_TASK) -> list[tuple[SvrForecaster, float | None]]:
    """(model, mean squared error over its test rows) of every job; ``order`` names the positions that jobs speak of."""
    kinds = list(dict.fromkeys((j.params.pca, j.train_end) for j in jobs))
    known = lambda end: train if end is None else train.where(F.col(order) < end)
    with ThreadPool(min(4, len(kinds))) as pool:
        prepared = pool.map(lambda k: Pipeline(stages=feature_stages(features, True, k[0])).fit(known(k[1])), kinds)
    maps = [affine_of(p, len(features)) for p in prepared]
    place = F.lit(0).cast("bigint") if order is None else F.col(order).cast("bigint")
    label = F.col(target).cast("double")
    label = F.when(label.isNull() | F.isnan(label), F.raise_error(F.lit("labels must not be null or NaN"))).otherwise(label)
    source = train.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), label.alias("y"), place.alias("pos"))
    tasks = max(1, min(train.sparkSession.sparkContext.defaultParallelism, -(-train.count() // rows_per_task)))
    # Rows that fit one task are copied, so that the models can be dealt out.
    groups = min(train.sparkSession.sparkContext.defaultParallelism, len(jobs)) if tasks == 1 else 1
    if groups > 1:
        spread = source.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartitionById(groups, F.col("group"))
    else:
        spread = source.repartition(tasks)
    rows = spread.persist(StorageLevel.MEMORY_AND_DISK)
    fits = {i: _Fit(j, *maps[kinds.index((j.params.pca, j.train_end))]) for i, j in enumerate(jobs)}
    ends = list(dict.fromkeys(j.train_end for j in jobs))
    seen = [F.lit(True) if e is None else F.col("pos") < e for e in ends]
    base = rows.agg(*[c for s in seen for c in (F.avg(F.when(s, F.col("y"))), F.stddev_pop(F.when(s, F.col("y"))))]).first()
    for fit in fits.values():
        at = 2 * ends.index(fit.job.train_end)
        fit.intercept, fit.edge = base[at], EDGE * (base[at + 1] or 1.0)
        fit.tried = [(fit.beta, fit.intercept)]
    for i, losses in _sums(rows, fits, "losses", groups).items():
        fits[i].best = fits[i].values(losses)[0]
    active = {i: f for i, f in fits.items() if f.job.params.max_iter > 0}
    while active:
        aimed = _sums(rows, active, "moments", groups)
        active = {i: f for i, f in active.items() if f.aim(aimed[i])}
        losses = _sums(rows, active, "losses", groups)
        active = {i: f for i, f in active.items() if f.move(losses[i])}
    errors = _sums(rows, {i: f for i, f in fits.items() if f.job.test_end is not None}, "squares", groups)
    rows.unpersist()
    out = []
    for i, fit in fits.items():
        p, kind = fit.job.params, kinds.index((fit.job.params.pca, fit.job.train_end))
        params = {"kernel": p.kernel, "size": fit.matrix.shape[1], "gamma": p.gamma, "count": p.components, "seed": p.seed}
        error = float(errors[i][0] / errors[i][1]) if i in errors and errors[i][1] else None
        out.append((SvrForecaster(prepared[kind], params, [float(b) for b in fit.beta], float(fit.intercept)), error))
    return out


def fit_svr(train: DataFrame, features: Sequence[str], target: str, **params) -> SvrForecaster:
    """Minimise |w|^2 / 2 + C * sum of the epsilon-insensitive errors; ``params`` are those of :class:`SvrParams`."""
    return train_svr(train, features, target, [SvrJob(SvrParams(**params))])[0][0]
