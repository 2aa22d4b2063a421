"""Linear and tree-ensemble forecasters built from Spark ML learners."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import feature_stages
from ..operators.split import chronological_split
from ..schema import FEATURES, TARGET
from .adaboost import adaboost_params
from .base import Evaluation, Forecaster, PipelineForecaster, fit_and_evaluate
from .growing import TreeParams
from .registry import best_params
from .shards import fit_ensembles
from .svr import fit_svr

SEED = 42


# Tree ensembles: the meaning of each algorithm's parameters.
def _gradient_boosting(p):
    return TreeParams(
        trees=p["n_estimators"], rate=p["learning_rate"], depth=p["max_depth"], min_leaf=p["min_samples_leaf"], min_split=p["min_samples_split"],
        seed=SEED,
    )


def _histogram(p):
    # At most 31 leaves, the best one split first.
    return TreeParams(grow="leaf", trees=p["max_iter"], rate=p["learning_rate"], depth=p["max_depth"], min_leaf=p["min_samples_leaf"], min_hessian=1e-3, seed=SEED)


def _xgboost(p):
    # The hessian of the squared error is 1 a row.
    return TreeParams(
        trees=p["n_estimators"], rate=p["learning_rate"], depth=p["max_depth"], min_hessian=p["min_child_weight"], reg_lambda=p.get("reg_lambda", 1.0),
        gamma=p.get("gamma", 0.0), row_share=p["subsample"], column_share=p["colsample_bytree"], seed=SEED,
    )


def _catboost(p):
    return TreeParams(kind="ordered", trees=p["iterations"], rate=p["learning_rate"], depth=p["depth"], reg_lambda=p["l2_leaf_reg"], seed=SEED)


def _forest(p):
    return TreeParams(
        kind="forest", trees=p["n_estimators"], depth=p["max_depth"], node_columns=p["max_features"], min_leaf=p["min_samples_leaf"],
        min_split=p["min_samples_split"], seed=SEED,
    )


def _adaboost(p):
    return adaboost_params(p["n_estimators"], p["learning_rate"], p["max_depth"], SEED)


def _linear(p, target):
    return LinearRegression(featuresCol="features", labelCol=target, solver="normal", regParam=0.0)


# Learner, scaling, principal components (share of variance or number).
ENSEMBLES = {
    "gradient_boosting": (_gradient_boosting, True, 0.95),
    "histogram_gradient_boosting": (_histogram, True, 0.95),
    "xgboost": (_xgboost, True, 4),
    "catboost": (_catboost, False, None),
    "adaboost": (_adaboost, True, None),
    "random_forest": (_forest, True, 0.95),
    "random_forest_raw": (_forest, False, None),
}
RECIPES = {
    "linear": (_linear, True, 0.95),
    "linear_raw": (_linear, False, None),
}


def model_params(algorithm: str, freq: str, **overrides) -> dict:
    """Registry parameters of an algorithm with overrides."""
    if algorithm in ("linear", "linear_raw"):
        return dict(overrides)
    params = best_params("random_forest" if algorithm == "random_forest_raw" else algorithm, freq)
    params.update(overrides)
    return params


def ensemble_recipe(algorithm: str, freq: str, **overrides) -> tuple[TreeParams, bool, float | None]:
    """(parameters, scaled?, components) of a tree ensemble with its registry parameters."""
    build, scale, pca = ENSEMBLES[algorithm]
    params = model_params(algorithm, freq, **overrides)
    pca = params.pop("pca", pca)
    return build(params), scale, pca


def make_model(
    algorithm: str,
    freq: str,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    **overrides,
) -> Callable[[DataFrame], Forecaster]:
    """The fit function of a named model with its registry parameters; an unknown name is an error.

    ``pca`` among the overrides replaces the share of variance or component count.
    """
    if algorithm in ENSEMBLES:
        recipe = ensemble_recipe(algorithm, freq, **overrides)
        return lambda train: fit_ensembles(train, features, target, [recipe])[0]
    if algorithm == "svr":
        return lambda train: fit_svr(train, features, target, **model_params(algorithm, freq, **overrides))
    if algorithm not in RECIPES:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    build, scale, pca = RECIPES[algorithm]
    params = model_params(algorithm, freq, **overrides)
    stages = [*feature_stages(features, scale, params.pop("pca", pca)), build(params, target)]
    return lambda train: PipelineForecaster(Pipeline(stages=stages).fit(train))


def train_and_evaluate(
    df: DataFrame,
    algorithm: str,
    freq: str,
    time_col: str,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    **overrides,
) -> Evaluation:
    """Fit a named model on the train rows and score validation and test."""
    fit = make_model(algorithm, freq, features, target, **overrides)
    return fit_and_evaluate(df, fit, time_col, algorithm, freq, features, target)


def feature_importance(
    df: DataFrame,
    time_col: str,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    top: int = 10,
    trees: int = 100,
    max_depth: int = 20,
) -> DataFrame:
    """The ``top`` features by importance in a random forest fitted on the train rows."""
    split = chronological_split(df.select(time_col, target, *features), time_col)
    forest = RandomForestRegressor(
        featuresCol="features", labelCol=target, numTrees=trees, maxDepth=max_depth, featureSubsetStrategy="all", seed=SEED
    )
    model = Pipeline(stages=[*feature_stages(features, False, None), forest]).fit(split.filter(F.col("split") == "train"))
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(features, weights)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(top)
