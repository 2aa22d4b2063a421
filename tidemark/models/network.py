"""Window networks (dense, convolutional, recurrent) trained in parallel on Spark.

Every epoch each task streams its share of the windows through mini-batch Adam,
starting from the same weights and moments; the resulting vectors are averaged by
Spark, weighted by rows, in two steps, and become the start of the next epoch. A
task holds one Arrow batch and one copy of the weights.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import score
from ..operators.ordered import profile
from ..operators.scale import WINDOW, window_dataset
from ..schema import CHANNELS
from ..session import cut_lineage
from .base import Evaluation, Forecaster
from .registry import best_params

# Training settings.
EPOCHS = 10
# Parts of the train rows whose weights are averaged after an epoch.
SHARDS = 8
BATCH = 32
PATIENCE = 10
DROPOUT = 0.25
ADAM = (0.9, 0.999, 1e-7)
CONV_KERNEL = 2


@dataclass(frozen=True)
class Net:
    """First layer by ``kind`` (dnn, cnn, lstm), then dense layers, optional dropout, linear output."""

    kind: str
    window: int
    channels: int
    units: tuple
    activations: tuple
    dropout: bool = False

    def shapes(self) -> list[tuple]:
        first = self.units[0]
        if self.kind == "dnn":
            out, width = [(self.window * self.channels, first), (first,)], first
        elif self.kind == "cnn":
            out, width = [(CONV_KERNEL * self.channels, first), (first,)], (self.window - CONV_KERNEL + 1) * first
        elif self.kind == "lstm":
            out, width = [(self.channels + first, 4 * first), (4 * first,)], first
        else:
            raise ValueError(f"unknown network {self.kind!r}")
        for size in [*self.units[1:], self.channels]:
            out += [(width, size), (size,)]
            width = size
        return out

    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes())

    def initial(self, seed: int = 42) -> np.ndarray:
        """Glorot-uniform weights, zero biases (one for the forget gate)."""
        rng, flat = np.random.default_rng(seed), []
        for i, s in enumerate(self.shapes()):
            if len(s) == 2:
                bound = math.sqrt(6.0 / (s[0] + s[1]))
                flat.append(rng.uniform(-bound, bound, s).ravel())
            else:
                bias = np.zeros(s)
                if self.kind == "lstm" and i == 1:
                    bias[self.units[0] : 2 * self.units[0]] = 1.0
                flat.append(bias)
        return np.concatenate(flat)

    def unpack(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.shapes():
            n = int(np.prod(s))
            out.append(flat[at : at + n].reshape(s))
            at += n
        return out

    def _first(self, x, w, b):
        """Output of the first layer and what its gradient needs."""
        act = self.activations[0]
        if self.kind == "lstm":
            return _lstm_forward(x, w, b, self.units[0], act)
        if self.kind == "cnn":
            pairs = np.concatenate([x[:, i : self.window - CONV_KERNEL + 1 + i] for i in range(CONV_KERNEL)], axis=2)
        else:
            pairs = x.reshape(len(x), 1, -1)
        out = _act(pairs @ w + b, act)
        return out.reshape(len(x), -1), (pairs, out)

    def _first_gradient(self, grad, kept, w):
        act = self.activations[0]
        if self.kind == "lstm":
            return _lstm_backward(grad, kept, w, self.units[0], act)
        pairs, out = kept
        delta = grad.reshape(out.shape) * _slope(out, act)
        flat = delta.reshape(-1, out.shape[2])
        return pairs.reshape(-1, pairs.shape[2]).T @ flat, flat.sum(axis=0)

    def predict(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        w = self.unpack(flat)
        h, _ = self._first(x, w[0], w[1])
        for i in range(1, len(self.units)):
            h = _act(h @ w[2 * i] + w[2 * i + 1], self.activations[i])
        return h @ w[-2] + w[-1]

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, rng) -> np.ndarray:
        """Gradient of the mean squared error over all channels."""
        w = self.unpack(flat)
        h, kept = self._first(x, w[0], w[1])
        hidden = [h]
        for i in range(1, len(self.units)):
            hidden.append(_act(hidden[-1] @ w[2 * i] + w[2 * i + 1], self.activations[i]))
        keep = (rng.random(hidden[-1].shape) >= DROPOUT) / (1.0 - DROPOUT) if self.dropout else 1.0
        last = hidden[-1] * keep
        delta = 2.0 * (last @ w[-2] + w[-1] - y) / y.size
        grads = [last.T @ delta, delta.sum(axis=0)]
        delta = (delta @ w[-2].T) * keep
        for i in range(len(self.units) - 1, 0, -1):
            delta = delta * _slope(hidden[i], self.activations[i])
            grads = [hidden[i - 1].T @ delta, delta.sum(axis=0), *grads]
            delta = delta @ w[2 * i].T
        return np.concatenate([g.ravel() for g in [*self._first_gradient(delta, kept, w[0]), *grads]])


def _act(z, name):
    return np.maximum(z, 0.0) if name == "relu" else np.tanh(z)


def _slope(out, name):
    """Derivative of the activation from its output."""
    return (out > 0).astype(float) if name == "relu" else 1.0 - out * out


def _sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _lstm_forward(x, w, b, units, act):
    h = c = np.zeros((len(x), units))
    steps = []
    for t in range(x.shape[1]):
        joined = np.hstack([x[:, t], h])
        i, f, g, o = np.split(joined @ w + b, 4, axis=1)
        i, f, g, o = _sigmoid(i), _sigmoid(f), _act(g, act), _sigmoid(o)
        before, c = c, f * c + i * g
        shown = _act(c, act)
        h = o * shown
        steps.append((joined, i, f, g, o, before, shown))
    return h, steps


def _lstm_backward(grad, steps, w, units, act):
    dw, db, dc = np.zeros_like(w), np.zeros(w.shape[1]), 0.0
    for joined, i, f, g, o, before, shown in reversed(steps):
        dc = dc + grad * o * _slope(shown, act)
        gates = np.hstack(
            [dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * _slope(g, act), grad * shown * o * (1 - o)]
        )
        dw += joined.T @ gates
        db += gates.sum(axis=0)
        grad = (gates @ w.T)[:, -units:]
        dc = dc * f
    return dw, db


def _tensors(pdf: pd.DataFrame, net: Net) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack(pdf["x"].to_numpy()).reshape(len(pdf), net.window, net.channels)
    return x, np.stack(pdf["y"].to_numpy())


def _epoch(net: Net, start, rate: float, steps_done: int, seed: int):
    """Partition function: one pass of mini-batch Adam, one row (weights and moments, rows, steps)."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, steps_done, task])
        flat, m, v = (a.copy() for a in start.value)
        b1, b2, eps = ADAM
        rows, step = 0, steps_done
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = _tensors(pdf, net)
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                pick = order[at : at + BATCH]
                g = net.gradient(flat, x[pick], y[pick], rng)
                step += 1
                m = b1 * m + (1 - b1) * g
                v = b2 * v + (1 - b2) * g * g
                flat = flat - rate * (m / (1 - b1**step)) / (np.sqrt(v / (1 - b2**step)) + eps)
            rows += len(x)
        if rows:
            yield pd.DataFrame({"task": [task], "vector": [np.concatenate([flat, m, v])], "n": [float(rows)], "steps": [step]})

    return run


def _average(trained: DataFrame, parts: int) -> tuple[np.ndarray, int]:
    """Row-weighted mean of the vectors, merged in groups before the last merge."""
    mean = lambda df, weight: Summarizer.metrics("mean").summary(F.col("vector"), F.col(weight))["mean"].alias("vector")
    vectors = trained.withColumn("vector", array_to_vector("vector"))
    groups = max(1, math.isqrt(parts))
    first = vectors.groupBy((F.col("task") % groups).alias("g")).agg(
        mean(vectors, "n"), F.sum("n").alias("n"), F.max("steps").alias("steps")
    )
    last = first.agg(mean(first, "n"), F.max("steps").alias("steps")).first()
    return last["vector"].toArray(), int(last["steps"])


def _squared_error(net: Net, weights):
    """Partition function: summed squared error and count, one row per task."""

    def run(batches):
        total, n = 0.0, 0
        for pdf in batches:
            if len(pdf):
                x, y = _tensors(pdf, net)
                total += float(((net.predict(weights.value, x) - y) ** 2).sum())
                n += y.size
        yield pd.DataFrame({"e": [total], "n": [n]})

    return run


def mean_squared_error(rows: DataFrame, net: Net, flat: np.ndarray) -> float:
    sent = rows.sparkSession.sparkContext.broadcast(flat)
    row = rows.mapInPandas(_squared_error(net, sent), "e double, n long").agg(F.sum("e"), F.sum("n")).first()
    sent.unpersist()
    return row[0] / row[1] if row[1] else math.inf


class NetworkForecaster(Forecaster):
    """Predicts the target channel, in original units, for windows with a flat ``x``."""

    kind = "network"

    def __init__(self, net: Net, flat: np.ndarray, low: float, high: float, history: list[float] | None = None):
        self.net, self.flat, self.low, self.high = net, np.asarray(flat, dtype=float), low, high
        self.history = history or []

    def transform(self, df: DataFrame) -> DataFrame:
        net, sent = self.net, df.sparkSession.sparkContext.broadcast(self.flat)

        @F.pandas_udf("double")
        def first_channel(x: pd.Series) -> pd.Series:
            tensor = np.stack(x.to_numpy()).reshape(len(x), net.window, net.channels)
            return pd.Series(net.predict(sent.value, tensor)[:, 0])

        span = (self.high - self.low) or 1.0
        return df.withColumn("prediction", first_channel("x") * F.lit(span) + F.lit(self.low))

    def meta(self) -> dict:
        return {"net": asdict(self.net), "flat": self.flat.tolist(), "low": self.low, "high": self.high, "history": self.history}

    @classmethod
    def restore(cls, meta, parts):
        spec = {k: tuple(v) if isinstance(v, list) else v for k, v in meta["net"].items()}
        return cls(Net(**spec), meta["flat"], meta["low"], meta["high"], meta["history"])


def fit_network(
    train: DataFrame,
    validation: DataFrame,
    net: Net,
    learning_rate: float,
    epochs: int = EPOCHS,
    patience: int | None = None,
    shards: int = SHARDS,
    seed: int = 42,
) -> tuple[np.ndarray, list[float]]:
    """Best weights by validation error and the error after every epoch.

    The rows are cut into ``shards`` by a hash of their position, whatever the cluster,
    and each shard is read in order of position: a task that is repeated, here or on
    another number of cores, trains alike.
    """
    sc = train.sparkSession.sparkContext
    spread = train.repartition(shards, F.xxhash64("pos")).sortWithinPartitions("pos").persist(StorageLevel.MEMORY_AND_DISK)
    zeros = np.zeros(net.size())
    state = (net.initial(seed), zeros, zeros)
    best, best_error, history, steps, waited = state[0], math.inf, [], 0, 0
    for _ in range(epochs):
        sent = sc.broadcast(state)
        trained = spread.mapInPandas(
            _epoch(net, sent, learning_rate, steps, seed), "task long, vector array<double>, n double, steps long"
        )
        vector, steps = _average(trained, shards)
        sent.unpersist()
        state = tuple(np.split(vector, 3))
        state = (state[0], state[1], np.maximum(state[2], 0.0))
        error = mean_squared_error(validation, net, state[0])
        history.append(error)
        if error < best_error:
            best, best_error, waited = state[0], error, 0
        else:
            waited += 1
            if patience is not None and waited >= patience:
                break
    spread.unpersist()
    return best, history


def _flat_windows(windows: DataFrame) -> DataFrame:
    return windows.withColumn("x", F.flatten("x"))


def window_forecast(
    df: DataFrame,
    kind: str,
    freq: str,
    time_col: str,
    channels: Sequence[str] = CHANNELS,
    fit_on: str = "all",
    window: int | None = None,
    epochs: int = EPOCHS,
    shards: int = SHARDS,
    **overrides,
) -> Evaluation:
    """Train a network on the train windows and score the target channel on validation and test.

    ``overrides`` replace registry parameters (units, activations, dropout, learning_rate).
    """
    params = {**best_params(kind, freq), **overrides}
    # Read several times, so stored first.
    df = cut_lineage(df.select(time_col, *channels))
    windows, bounds = window_dataset(df, time_col, freq, channels, fit_on, window)
    rows = cut_lineage(_flat_windows(windows))
    width = len(bounds)
    length = window or WINDOW[freq]
    net = Net(kind, length, width, tuple(params["units"]), tuple(params["activations"]), params["dropout"])
    train, held = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "validation")
    # Early stopping belongs to the hourly networks only.
    patience = PATIENCE if freq == "H" else None
    flat, history = fit_network(train, held, net, params["learning_rate"], epochs, patience, shards)
    low, high = (float(v) for v in bounds[channels[0]])
    model = NetworkForecaster(net, flat, low, high, history)
    span = (high - low) or 1.0
    predictions = model.transform(rows.filter(F.col("split") != "train")).select(
        F.col("y_time").alias(time_col),
        (F.col("y")[0] * F.lit(span) + F.lit(low)).alias("actual"),
        F.col("prediction").alias("predicted"),
        "split",
        F.lit(kind).alias("model"),
        F.lit(freq).alias("freq"),
    )
    scores = score(predictions, time_col, by=["model", "freq", "split"], prof=profile(predictions, time_col))
    return Evaluation(model, predictions, scores)
