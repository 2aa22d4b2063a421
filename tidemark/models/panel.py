"""Forecasters of many series at once: one model per key, fitted by one aggregate of fixed width.

The centred cross products of all keys come from built-in aggregates, so a key with a third of the
rows is one partial row per task like any other. The small systems of all keys are
solved in Arrow batches, one batched factorisation each. A result row per key is joined to the rows to
predict; AQE splits the rows of a hot key. Each series goes by one struct of its keys, which is never null:
rows that a window has dealt out by it stay where they are in the aggregates, joins and windows that
follow, and one profile of the table serves all of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import score
from ..operators.ordered import Profile, place, profile
from ..operators.split import chronological_split
from ..schema import FEATURES, TARGET

# Directions with less than this share of the largest variance of a key carry no coefficient.
RANK = 1e-12


def fit_linear_per_key(train: DataFrame, keys: Sequence[str], features: Sequence[str] = FEATURES, target: str = TARGET) -> DataFrame:
    """``keys…, coefficients, intercept, rows``: least squares of every key.

    Rows with a null in the target or a feature teach nothing, and a key without complete rows has no
    result. Features that are constant or repeat others within a key share the coefficient of smallest norm.
    """
    p = len(features)
    names = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    plain = train.select(*keys, *names, F.col(target).cast("double").alias("y")).dropna(subset=[*(f"x{i}" for i in range(p)), "y"])
    columns = [*(f"x{i}" for i in range(p)), "y"]
    centred = [F.covar_pop(columns[i], columns[j]) for i in range(p) for j in range(i, p + 1)]
    sums = plain.groupBy(*keys).agg(F.array(*[F.avg(c) for c in columns]).alias("means"), F.array(*centred).alias("products"), F.count("*").alias("rows"))

    def solve(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        upper, at = [(i, j) for i in range(p) for j in range(i, p + 1)], len(keys)
        for batch in batches:
            if not batch.num_rows:
                continue
            means = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, p + 1)
            products = batch.column(at + 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(upper))
            left, right = np.zeros((len(means), p, p)), np.zeros((len(means), p))
            for c, (i, j) in enumerate(upper):
                if j == p:
                    right[:, i] = products[:, c]
                else:
                    left[:, i, j] = left[:, j, i] = products[:, c]
            # Scaled to equal variances, so that the cut of RANK means the same for all units.
            size = np.sqrt(np.maximum(np.einsum("kii->ki", left), 0.0))
            size[size == 0] = 1.0
            values, axes = np.linalg.eigh(left / size[:, :, None] / size[:, None, :])
            inverse = np.divide(1.0, values, out=np.zeros_like(values), where=values > RANK * values[:, -1:])
            turned = np.einsum("kij,ki->kj", axes, right / size) * inverse
            found = np.einsum("kij,kj->ki", axes, turned) / size
            intercept = means[:, p] - (found * means[:, :p]).sum(axis=1)
            coefficients = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, p), pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], coefficients, pa.array(intercept), batch.column(at + 2)], [*keys, "coefficients", "intercept", "rows"])

    kinds = [f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys]
    return sums.mapInArrow(solve, ", ".join([*kinds, "coefficients array<double>", "intercept double", "rows bigint"]))


# The struct of a row's keys.
SERIES = "__series"


def _with_model(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Each row with the result of its series; structs with null keys meet."""
    other = model.withColumnRenamed(SERIES, "__of")
    return rows.join(other, F.col(SERIES) == F.col("__of"), "left").drop("__of")


def _named(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys in place of their struct."""
    return rows.select(*(F.col(SERIES)[k].alias(k) for k in keys), *(F.col(f"`{c}`") for c in rows.columns if c != SERIES))


def _line(features: Sequence[str]):
    """The regression's value from its coefficients; null where a feature is null."""
    total = F.col("intercept")
    for i, f in enumerate(features):
        total = total + F.col("coefficients")[i] * F.col(f).cast("double")
    return total


def _lined(df: DataFrame, time_col: str, keys: Sequence[str], features: Sequence[str], target: str, prof: Profile) -> DataFrame:
    """``linear_predictions_per_key`` with the struct of the keys in their place."""
    rows = df.select(F.struct(*keys).alias(SERIES), time_col, target, *features)
    split = chronological_split(rows, time_col, keys=[SERIES], prof=prof)
    model = fit_linear_per_key(split.where("split = 'train'"), [SERIES], features, target)
    made = _with_model(split, model)
    return made.select(SERIES, time_col, F.col(target).cast("double").alias("actual"), _line(features).alias("predicted"), "pos", "split")


def linear_predictions_per_key(
    df: DataFrame, time_col: str, keys: Sequence[str], features: Sequence[str] = FEATURES, target: str = TARGET, prof: Profile | None = None
) -> DataFrame:
    """``keys…, time, actual, predicted, pos, split`` of all rows, each series split and fitted on its own.

    A null feature or a key without a model predicts null. ``prof`` is the profile of the rows
    or of rows that these are a part of.
    """
    prof = prof or profile(df, time_col, keys)
    return _named(_lined(df, time_col, keys, features, target, prof), keys)


def _scores(rows: DataFrame, time_col: str, keys: Sequence[str], name: str, freq: str, prof: Profile) -> DataFrame:
    held = rows.where("split <> 'train'").withColumns({"model": F.lit(name), "freq": F.lit(freq)})
    return _named(score(held, time_col, by=[SERIES, "model", "freq", "split"], prof=prof), keys)


def linear_forecast_per_key(
    df: DataFrame, freq: str, time_col: str, keys: Sequence[str], features: Sequence[str] = FEATURES, target: str = TARGET, prof: Profile | None = None
) -> DataFrame:
    """Validation and test scores of one linear model per key."""
    prof = prof or profile(df, time_col, keys)
    return _scores(_lined(df, time_col, keys, features, target, prof), time_col, keys, "linear", freq, prof)


def _ar1(df: DataFrame, time_col: str, keys: Sequence[str], features: Sequence[str], target: str, prof: Profile) -> DataFrame:
    """``ar1_predictions_per_key`` with the struct of the keys in their place."""
    lined = _lined(df, time_col, keys, features, target, prof)
    residual = lined.where("split = 'train'").withColumn("v", F.col("actual") - F.col("predicted"))
    before = place(residual.select(SERIES, time_col, "pos", "v"), time_col, [SERIES], before={"u": "v"}, prof=prof)
    errors = before.groupBy(SERIES).agg(
        F.coalesce(F.try_divide(F.sum(F.col("v") * F.col("u")), F.sum(F.when(F.col("v").isNotNull(), F.col("u") * F.col("u")))), F.lit(0.0)).alias("phi"),
        F.max_by("v", "pos").alias("last"),
        F.max("pos").alias("end"),
    )
    held = _with_model(lined, errors)
    ahead = F.col("predicted") + F.pow("phi", F.col("pos") - F.col("end")) * F.coalesce("last", F.lit(0.0))
    return held.select(SERIES, time_col, "actual", F.when(F.col("split") == "train", F.col("predicted")).otherwise(ahead).alias("predicted"), "pos", "split")


def ar1_predictions_per_key(
    df: DataFrame, time_col: str, keys: Sequence[str], features: Sequence[str] = FEATURES, target: str = TARGET, prof: Profile | None = None
) -> DataFrame:
    """Regression with first-order autoregressive errors per key, forecast from the end of the train rows.

    The error's coefficient is the least-squares one of each residual on the one before; the forecast h rows
    after the last train row adds its h-th power times the last residual. A series without two
    neighbouring residuals has the coefficient 0.
    """
    prof = prof or profile(df, time_col, keys)
    return _named(_ar1(df, time_col, keys, features, target, prof), keys)


def arx_forecast_ar1_per_key(
    df: DataFrame, freq: str, time_col: str, keys: Sequence[str], features: Sequence[str] = FEATURES, target: str = TARGET, prof: Profile | None = None
) -> DataFrame:
    """Validation and test scores of one regression with first-order errors per key."""
    prof = prof or profile(df, time_col, keys)
    return _scores(_ar1(df, time_col, keys, features, target, prof), time_col, keys, "sarimax", freq, prof)
