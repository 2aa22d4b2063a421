"""AdaBoost.R2 (Drucker 1997): all rounds in one stage, the weighted median as one function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .growing import TreeParams
from .packed import EnsembleForecaster
from .shards import fit_ensemble


def adaboost_params(n_estimators: int, learning_rate: float, max_depth: int, seed: int = 42) -> TreeParams:
    return TreeParams(kind="adaboost", trees=n_estimators, rate=learning_rate, depth=max_depth, seed=seed)


def fit_adaboost(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    n_estimators: int,
    learning_rate: float,
    max_depth: int,
    seed: int = 42,
) -> EnsembleForecaster:
    """Reweight the rows by their linear loss after every tree; features are scaled."""
    return fit_ensemble(train, features, target, adaboost_params(n_estimators, learning_rate, max_depth, seed), scale=True)
