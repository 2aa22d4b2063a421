"""Scaling, principal components and model inputs."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import preprocess_time_series, time_feature_names
from ..schema import CHANNELS, FEATURES, TARGET
from .ordered import Profile, profile, with_group_stats
from .sequence import create_windows
from .split import chronological_split, split_label

# Window length by frequency.
WINDOW = {"H": 24, "D": 24, "W": 24, "M": 12}


def _seen(column: str, fit_on: str, split: str) -> Column:
    """The values a fit may look at."""
    value = F.col(f"`{column}`").cast("double")
    if fit_on == "all":
        return value
    if fit_on == "train":
        return F.when(F.col(split) == "train", value)
    raise ValueError(f"unknown fit_on {fit_on!r}")


def standard_scale(
    df: DataFrame,
    columns: Sequence[str],
    fit_on: str = "train",
    split: str = "split",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Zero mean and unit population variance, fitted on the train rows; a constant column becomes x - mean."""
    stats = {}
    for i, c in enumerate(columns):
        stats[f"__m{i}"] = F.avg(_seen(c, fit_on, split))
        stats[f"__s{i}"] = F.stddev_pop(_seen(c, fit_on, split))
    fitted = with_group_stats(df, stats, keys)
    spread = lambda i: F.when(F.col(f"__s{i}") > 0, F.col(f"__s{i}")).otherwise(1.0)
    return fitted.withColumns({c: (F.col(f"`{c}`") - F.col(f"__m{i}")) / spread(i) for i, c in enumerate(columns)}).drop(*stats)


def minmax_bounds(df: DataFrame, columns: Sequence[str], fit_on: str = "all", split: str = "split") -> dict[str, tuple]:
    """Minimum and maximum of every column: two numbers each."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.min(_seen(c, fit_on, split)).alias(f"lo{i}"), F.max(_seen(c, fit_on, split)).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def minmax_scale(df: DataFrame, bounds: Mapping[str, tuple]) -> DataFrame:
    """Map each column to [0, 1] by the given bounds; a constant column becomes 0."""
    cols = {}
    for c, (lo, hi) in bounds.items():
        span = (hi - lo) or 1.0
        cols[c] = (F.col(f"`{c}`").cast("double") - F.lit(float(lo))) / F.lit(float(span))
    return df.withColumns(cols)


def minmax_inverse(df: DataFrame, bounds: Mapping[str, tuple]) -> DataFrame:
    """Undo :func:`minmax_scale`."""
    cols = {}
    for c, (lo, hi) in bounds.items():
        span = (hi - lo) or 1.0
        cols[c] = F.col(f"`{c}`") * F.lit(float(span)) + F.lit(float(lo))
    return df.withColumns(cols)


class PopulationScaler(Estimator):
    """Standard scaling with the population deviation, as a pair of built-in stages.

    The built-in scaler divides by the sample deviation; the factor
    sqrt(n / (n - 1)) turns one into the other.
    """

    def __init__(self, input_col: str, output_col: str):
        super().__init__()
        self.input_col, self.output_col = input_col, output_col

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        sample = self.output_col + "_sample"
        model = StandardScaler(withMean=True, withStd=True, inputCol=self.input_col, outputCol=sample).fit(dataset)
        rows = dataset.count()
        factor = math.sqrt(rows / (rows - 1)) if rows > 1 else 1.0
        rescale = ElementwiseProduct(
            scalingVec=Vectors.dense([factor] * model.mean.size), inputCol=sample, outputCol=self.output_col
        )
        return PipelineModel([model, rescale])


def components_for(ratios: Sequence[float], retain: float) -> int:
    """Fewest components whose cumulative explained variance exceeds ``retain``."""
    return min(len(ratios), 1 + int(np.searchsorted(np.cumsum(ratios), retain, side="right")))


class VariancePCA(Estimator):
    """Principal components: a fixed number (``retain >= 1``) or a share of variance (``retain < 1``)."""

    def __init__(self, retain: float, input_col: str, output_col: str):
        super().__init__()
        self.retain, self.input_col, self.output_col = retain, input_col, output_col

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        size = len(dataset.select(self.input_col).first()[0])
        every = self.output_col + "_all"
        model = PCA(k=size, inputCol=self.input_col, outputCol=every).fit(dataset)
        ratios = model.explainedVariance.toArray()
        keep = components_for(ratios, self.retain) if self.retain < 1 else min(size, int(self.retain))
        slicer = VectorSlicer(inputCol=every, outputCol=self.output_col, indices=list(range(keep)))
        return PipelineModel([model, slicer])


def feature_stages(
    features: Sequence[str] = FEATURES,
    scale: bool = True,
    pca: float | None = 0.95,
    output: str = "features",
) -> list:
    """Pipeline stages from columns to the model's feature vector."""
    last = "assembled" if scale or pca else output
    stages = [VectorAssembler(inputCols=list(features), outputCol=last)]
    if scale:
        stages.append(PopulationScaler(last, "scaled" if pca else output))
        last = "scaled"
    if pca:
        stages.append(VariancePCA(pca, last, output))
    return stages


def pca_variance(df: DataFrame, features: Sequence[str] = FEATURES, retain: float = 0.95, split: str = "split") -> DataFrame:
    """Components of the scaled features: ``component, ratio, cumulative, kept``; fitted on train rows if ``split`` exists."""
    train = df.filter(F.col(split) == "train") if split in df.columns else df
    fitted = Pipeline(stages=feature_stages(features, True, None, "scaled")).fit(train)
    model = PCA(k=len(features), inputCol="scaled", outputCol="pc").fit(fitted.transform(train))
    ratios = [float(r) for r in model.explainedVariance.toArray()]
    keep = components_for(ratios, retain)
    rows = [(i + 1, r, float(sum(ratios[: i + 1])), i < keep) for i, r in enumerate(ratios)]
    return df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double, kept boolean")


def sarimax_features(
    df: DataFrame,
    time_col: str,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    retain: float = 0.95,
    fit_on: str = "train",
    prof: Profile | None = None,
) -> DataFrame:
    """``time, pos, split, target``, the features and their principal components ``pc1 …``."""
    split = chronological_split(df.select(time_col, target, *features), time_col, prof=prof)
    rows = split.filter(F.col("split") == "train") if fit_on == "train" else split
    model = Pipeline(stages=feature_stages(features, True, retain, "pc")).fit(rows)
    kept = len(model.stages[-1].stages[-1].getIndices())
    made = model.transform(split).withColumn("__pc", vector_to_array("pc"))
    parts = [F.col("__pc")[i].alias(f"pc{i + 1}") for i in range(kept)]
    return made.select(time_col, "pos", "split", target, *features, *parts)


def window_dataset(
    df: DataFrame,
    time_col: str,
    freq: str,
    channels: Sequence[str] = CHANNELS,
    fit_on: str = "all",
    window: int | None = None,
    train_ratio: float = 0.6,
    validation_ratio: float = 0.2,
    prof: Profile | None = None,
) -> tuple[DataFrame, dict[str, tuple]]:
    """Time features, min-max scaling, sliding windows and their split; also the bounds of every channel.

    ``fit_on="train"`` takes the bounds from the rows that train windows can see.
    """
    window = window or WINDOW[freq]
    prof = prof or profile(df, time_col)
    table = preprocess_time_series(df, time_col, freq, channels)
    names = [*channels, *time_feature_names(freq)]
    if fit_on == "train":
        seen = chronological_split(table, time_col, train_ratio, validation_ratio, prof=prof)
        bounds = minmax_bounds(seen, names, "train")
    else:
        bounds = minmax_bounds(table, names)
    windows = create_windows(minmax_scale(table, bounds), names, time_col, window, prof=prof)
    label = split_label(F.col("pos"), F.col("n_windows"), train_ratio, validation_ratio)
    return windows.withColumn("split", label), bounds
