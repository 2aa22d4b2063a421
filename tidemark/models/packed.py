"""Tree ensembles as flat arrays, evaluated for many rows at once.

The plan of a prediction holds one vectorised function, however many trees there are.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Forecaster

CELLS = 1 << 20


def pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict:
    with np.load(io.BytesIO(data)) as found:
        return {name: found[name] for name in found.files}


class Trees:
    """Binary trees in one run of nodes: feature, threshold, children, way of missing values, value.

    Leaves point at themselves. A row goes left where its value is at most the threshold.
    """

    names = ("root", "feature", "threshold", "left", "right", "missing_left", "value")

    def __init__(self, root, feature, threshold, left, right, missing_left, value):
        self.root, self.feature, self.threshold = root, feature, threshold
        self.left, self.right, self.missing_left, self.value = left, right, missing_left, value

    @classmethod
    def join(cls, parts: Sequence[Trees]) -> Trees:
        """Several runs as one."""
        starts = np.cumsum([0, *(len(p.value) for p in parts)])[:-1]
        moved = lambda name: np.concatenate([getattr(p, name) + s for p, s in zip(parts, starts)])
        same = lambda name: np.concatenate([getattr(p, name) for p in parts])
        return cls(moved("root"), same("feature"), same("threshold"), moved("left"), moved("right"), same("missing_left"), same("value"))

    def arrays(self) -> dict:
        return {name: getattr(self, name) for name in self.names}

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The value of every tree for every row: rows by trees."""
        out = np.empty((len(x), len(self.root)))
        step = max(1, CELLS // max(1, len(self.root)))
        for begin in range(0, len(x), step):
            some = x[begin : begin + step]
            rows = np.arange(len(some))[:, None]
            at = np.broadcast_to(self.root, (len(some), len(self.root)))
            while True:
                value = some[rows, self.feature[at]]
                left = (value <= self.threshold[at]) | (np.isnan(value) & self.missing_left[at])
                following = np.where(left, self.left[at], self.right[at])
                if (following == at).all():
                    break
                at = following
            out[begin : begin + step] = self.value[at]
        return out


class Tables:
    """Oblivious trees: one split a level, so a leaf is a number made of the levels' answers.

    Missing values go left. A tree with fewer levels than the others repeats a split that all pass.
    """

    names = ("feature", "threshold", "value")

    def __init__(self, feature, threshold, value):
        self.feature, self.threshold, self.value = feature, threshold, value

    def arrays(self) -> dict:
        return {name: getattr(self, name) for name in self.names}

    def leaves(self, x: np.ndarray) -> np.ndarray:
        trees, levels = self.feature.shape
        out = np.empty((len(x), trees))
        step = max(1, CELLS // max(1, trees))
        for begin in range(0, len(x), step):
            some = x[begin : begin + step]
            at = np.zeros((len(some), trees), np.int64)
            for level in range(levels):
                at = 2 * at + (some[:, self.feature[:, level]] > self.threshold[:, level])
            out[begin : begin + step] = self.value[np.arange(trees), at]
        return out


SHAPES = {"trees": Trees, "tables": Tables}


def combine(leaves: np.ndarray, how: str, base: float, weights: np.ndarray) -> np.ndarray:
    """One prediction a row: base plus sum, mean, or the weighted median of the trees."""
    if how == "sum":
        return base + leaves.sum(axis=1)
    if how == "mean":
        return leaves.mean(axis=1)
    order = np.argsort(leaves, axis=1, kind="stable")
    run = np.cumsum(weights[order], axis=1)
    pick = np.argmax(run >= 0.5 * weights.sum(), axis=1)
    rows = np.arange(len(leaves))
    return leaves[rows, order[rows, pick]]


def mapped(x: np.ndarray, matrix: np.ndarray | None, offset: np.ndarray | None) -> np.ndarray:
    """``x @ matrix + offset`` one product at a time: the bits do not depend on how rows are batched."""
    if matrix is None:
        return x
    out = np.empty((len(x), matrix.shape[1]))
    for c in range(matrix.shape[1]):
        total = np.full(len(x), offset[c])
        for j in range(matrix.shape[0]):
            total = total + x[:, j] * matrix[j, c]
        out[:, c] = total
    return out


class EnsembleForecaster(Forecaster):
    """Packed trees over columns, scaled and turned by one affine map before."""

    kind = "ensemble"

    def __init__(self, features: Sequence[str], ensemble, how: str, base: float = 0.0, weights=None, matrix=None, offset=None):
        self.features, self.ensemble, self.how, self.base = list(features), ensemble, how, float(base)
        self.weights = np.ones(1) if weights is None else np.asarray(weights, float)
        self.matrix, self.offset = matrix, offset

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions of rows of plain features; NaN is a missing value."""
        return combine(self.ensemble.leaves(mapped(x, self.matrix, self.offset)), self.how, self.base, self.weights)

    def transform(self, df: DataFrame) -> DataFrame:
        predict = self.predict

        @F.pandas_udf("double")
        def predicted(x: pd.DataFrame) -> pd.Series:
            return pd.Series(predict(x.to_numpy(float, na_value=np.nan)))

        return df.withColumn("prediction", predicted(F.struct(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(self.features)])))

    def meta(self) -> dict:
        shape = next(name for name, kind in SHAPES.items() if isinstance(self.ensemble, kind))
        arrays = {**self.ensemble.arrays(), "__weights": self.weights}
        if self.matrix is not None:
            arrays |= {"__matrix": self.matrix, "__offset": self.offset}
        return {"features": self.features, "shape": shape, "how": self.how, "base": self.base, "arrays": base64.b64encode(pack(**arrays)).decode()}

    @classmethod
    def restore(cls, meta, parts):
        arrays = unpack(base64.b64decode(meta["arrays"]))
        weights, matrix, offset = arrays.pop("__weights"), arrays.pop("__matrix", None), arrays.pop("__offset", None)
        return cls(meta["features"], SHAPES[meta["shape"]](**arrays), meta["how"], meta["base"], weights, matrix, offset)
