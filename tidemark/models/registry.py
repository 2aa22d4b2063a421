"""Best parameters by model and frequency, and the spaces searched for them."""

from __future__ import annotations

import copy
import json
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.time import check_frequency

# Tuned parameters of every model at each frequency.
BEST_PARAMS = {
    "sarimax": {
        "H": {"order": (0, 0, 0), "seasonal_order": (0, 0, 0, 0)},
        "D": {"order": (6, 0, 1), "seasonal_order": (0, 0, 0, 0)},
        "W": {"order": (6, 0, 7), "seasonal_order": (0, 0, 0, 0)},
        "M": {"order": (3, 0, 6), "seasonal_order": (0, 0, 0, 0)},
    },
    "svr": {
        "H": {"C": 10.0, "epsilon": 1.0, "kernel": "rbf", "gamma": 0.01},
        "D": {"C": 1.0, "epsilon": 0.01, "kernel": "linear", "gamma": 1.0},
        "W": {"C": 10.0, "epsilon": 0.01, "kernel": "linear", "gamma": 0.001},
        "M": {"C": 10.0, "epsilon": 0.01, "kernel": "linear", "gamma": 0.001},
    },
    "gradient_boosting": {
        "H": {"learning_rate": 0.05, "max_depth": 6, "min_samples_leaf": 8, "min_samples_split": 6, "n_estimators": 202},
        "D": {"learning_rate": 0.05, "max_depth": 6, "min_samples_leaf": 8, "min_samples_split": 6, "n_estimators": 202},
        "W": {"learning_rate": 0.1, "max_depth": 5, "min_samples_leaf": 6, "min_samples_split": 6, "n_estimators": 357},
        "M": {"learning_rate": 0.1, "max_depth": 8, "min_samples_leaf": 2, "min_samples_split": 10, "n_estimators": 445},
    },
    "histogram_gradient_boosting": {
        f: {"learning_rate": 0.04410482473745831, "max_depth": 9, "max_iter": 373, "min_samples_leaf": 23} for f in "HDWM"
    },
    "xgboost": {
        f: {
            "n_estimators": 205 if f == "M" else 714,
            "max_depth": 7,
            "learning_rate": 0.06503043695984914,
            "subsample": 0.7229163764267956,
            "colsample_bytree": 0.8982714934301164,
            "min_child_weight": 5,
        }
        for f in "HDWM"
    },
    "adaboost": {
        "H": {"max_depth": 8, "learning_rate": 0.16297508346206444, "n_estimators": 70},
        "D": {"max_depth": 8, "learning_rate": 0.010974987654930561, "n_estimators": 199},
        "W": {"max_depth": 5, "learning_rate": 0.044306214575838825, "n_estimators": 363},
        "M": {"max_depth": 8, "learning_rate": 0.010974987654930561, "n_estimators": 199},
    },
    "catboost": {
        "H": {"l2_leaf_reg": 3, "learning_rate": 0.09999999999999999, "iterations": 200, "depth": 4},
        "D": {"l2_leaf_reg": 3, "learning_rate": 0.09999999999999999, "iterations": 200, "depth": 4},
        "W": {"l2_leaf_reg": 3, "learning_rate": 0.09999999999999999, "iterations": 200, "depth": 4},
        "M": {"l2_leaf_reg": 9, "learning_rate": 0.09999999999999999, "iterations": 500, "depth": 6},
    },
    "random_forest": {
        "H": {"max_depth": 28, "n_estimators": 472, "max_features": "log2", "min_samples_leaf": 7, "min_samples_split": 9},
        "D": {"max_depth": 9, "n_estimators": 714, "max_features": None, "min_samples_leaf": 8, "min_samples_split": 6},
        "W": {"max_depth": 21, "n_estimators": 266, "max_features": "log2", "min_samples_leaf": 5, "min_samples_split": 10},
        "M": {"max_depth": 21, "n_estimators": 266, "max_features": "log2", "min_samples_leaf": 5, "min_samples_split": 10},
    },
    "dnn": {
        "H": {"learning_rate": 0.00014014488528467923, "units": [448, 256, 160], "activations": ["tanh"] * 3, "dropout": True},
        "D": {"learning_rate": 0.0005906296261520694, "units": [224, 32, 96, 32, 160], "activations": ["tanh"] * 5, "dropout": True},
        "W": {"learning_rate": 0.0004077726925804003, "units": [352, 32, 32, 32], "activations": ["tanh"] * 4, "dropout": False},
        "M": {"learning_rate": 0.0040835753251513085, "units": [32, 32], "activations": ["tanh"] * 2, "dropout": False},
    },
    "lstm": {
        "H": {"learning_rate": 0.00019153080222192724, "units": [448, 224], "activations": ["tanh"] * 2, "dropout": False},
        "D": {"learning_rate": 0.0028652697828724623, "units": [480, 384, 288], "activations": ["tanh"] * 3, "dropout": True},
        "W": {
            "learning_rate": 0.0009513380195031257,
            "units": [480, 160, 64, 224, 512, 384],
            "activations": ["relu", "tanh", "tanh", "tanh", "tanh", "tanh"],
            "dropout": False,
        },
        "M": {
            "learning_rate": 0.0013383290456424192,
            "units": [288, 352, 480, 224, 192],
            "activations": ["relu", "tanh", "tanh", "tanh", "tanh"],
            "dropout": False,
        },
    },
    "cnn": {
        "H": {"learning_rate": 0.00021997838024224393, "units": [224, 256], "activations": ["relu", "tanh"], "dropout": False},
        "D": {"learning_rate": 0.0012918827423762096, "units": [96, 448, 96, 512, 320], "activations": ["tanh"] * 5, "dropout": True},
        "W": {"learning_rate": 0.0031087381681937547, "units": [96, 32, 96, 96], "activations": ["tanh"] * 4, "dropout": True},
        "M": {
            "learning_rate": 0.0009974518412524185,
            "units": [64, 448, 256, 64, 416],
            "activations": ["relu", "tanh", "tanh", "tanh", "tanh"],
            "dropout": True,
        },
    },
}


def best_params(model: str, freq: str) -> dict:
    """A copy of the tuned parameters; an unknown model or frequency is an error."""
    if model not in BEST_PARAMS:
        raise ValueError(f"unknown model {model!r}")
    return copy.deepcopy(BEST_PARAMS[model][check_frequency(freq)])


def best_params_table(spark: SparkSession) -> DataFrame:
    """The registry as rows ``model, freq, param, value`` (values as JSON text)."""
    rows = [
        (model, freq, param, json.dumps(value))
        for model, by_freq in BEST_PARAMS.items()
        for freq, params in by_freq.items()
        for param, value in params.items()
    ]
    return spark.createDataFrame(rows, "model string, freq string, param string, value string")


# Samplers of one value each; integer ranges exclude their end.
def integers(low: int, high: int):
    return lambda rng: rng.randrange(low, high)


def uniform(low: float, width: float):
    return lambda rng: rng.uniform(low, low + width)


def choice(values):
    values = list(values)
    return lambda rng: rng.choice(values)


def log_uniform(low: float, high: float):
    return lambda rng: float(np.exp(rng.uniform(np.log(low), np.log(high))))


def logspace(start: float, stop: float, count: int):
    return choice(float(v) for v in np.logspace(start, stop, count))


# Search spaces. Component counts above the four features and the
# forest's former "auto" (all features) are given in their valid form.
PARAM_SPACES = {
    "gradient_boosting": {
        "pca": choice([0.95, 0.99]),
        "n_estimators": integers(100, 500),
        "max_depth": integers(3, 10),
        "min_samples_split": integers(2, 11),
        "min_samples_leaf": integers(1, 11),
        "learning_rate": choice([0.01, 0.02, 0.05, 0.1]),
    },
    "histogram_gradient_boosting": {
        "pca": choice([0.95, 0.99]),
        "max_iter": integers(100, 1000),
        "max_depth": integers(3, 30),
        "min_samples_leaf": integers(20, 100),
        "learning_rate": uniform(0.01, 0.2),
    },
    "xgboost": {
        "pca": integers(3, 5),
        "n_estimators": integers(100, 1000),
        "max_depth": integers(3, 10),
        "learning_rate": uniform(0.01, 0.3),
        "min_child_weight": integers(1, 10),
        "subsample": uniform(0.5, 0.5),
        "colsample_bytree": uniform(0.5, 0.5),
    },
    "adaboost": {"n_estimators": integers(50, 500), "learning_rate": logspace(-2, 0, 100), "max_depth": integers(1, 11)},
    "catboost": {
        "depth": choice([4, 6, 8, 10]),
        "learning_rate": logspace(-3, 0, 10),
        "iterations": choice([100, 200, 500, 1000]),
        "l2_leaf_reg": choice([1, 3, 5, 7, 9]),
    },
    "random_forest": {
        "n_estimators": integers(100, 1000),
        "max_depth": integers(3, 30),
        "min_samples_split": integers(2, 11),
        "min_samples_leaf": integers(1, 11),
        "max_features": choice(["sqrt", "log2", None]),
    },
    "svr": {
        "pca": choice([0.85, 0.90, 0.95]),
        "C": logspace(-3, 3, 7),
        "epsilon": logspace(-3, 0, 4),
        "kernel": choice(["linear", "poly", "rbf"]),
        "gamma": logspace(-3, 1, 5),
    },
}


def param_space(model: str) -> dict:
    """Samplers by parameter; an unknown model is an error."""
    if model not in PARAM_SPACES:
        raise ValueError(f"unknown model {model!r}")
    return PARAM_SPACES[model]


def sample_params(model: str, n: int, seed: int = 42) -> list[dict]:
    """``n`` candidates from the space of the model."""
    rng, space = random.Random(seed), param_space(model)
    return [{name: draw(rng) for name, draw in space.items()} for _ in range(n)]


def sample_network(rng: random.Random) -> dict:
    """One network from the space of the network tuner."""
    layers = rng.randint(1, 5)
    first, rest = rng.choice(["relu", "tanh"]), rng.choice(["relu", "tanh"])
    return {
        "units": [32 * rng.randint(1, 16) for _ in range(layers)],
        "activations": [first, *[rest] * (layers - 1)],
        "dropout": rng.random() < 0.5,
        "learning_rate": log_uniform(1e-4, 1e-2)(rng),
    }
