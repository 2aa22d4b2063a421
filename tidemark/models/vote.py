"""Unweighted mean of several forecasters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES, TARGET
from .base import Evaluation, Forecaster, fit_and_evaluate
from .shards import fit_ensembles
from .tabular import ENSEMBLES, ensemble_recipe, make_model

# Members of the vote.
MEMBERS = (
    "gradient_boosting",
    "histogram_gradient_boosting",
    "xgboost",
    "adaboost",
    "catboost",
    "random_forest_raw",
    "svr",
    "linear_raw",
)


class VoteForecaster(Forecaster):
    kind = "vote"

    def __init__(self, members: list[Forecaster]):
        self.members = members

    def transform(self, df: DataFrame) -> DataFrame:
        """Each member adds a column to the same rows, so nothing is joined."""
        made, names = df, []
        for i, member in enumerate(self.members):
            names.append(f"__vote{i}")
            made = member.transform(made).withColumnRenamed("prediction", names[-1])
        mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
        return made.select(*df.columns, mean.alias("prediction"))

    def parts(self) -> list:
        return self.members

    @classmethod
    def restore(cls, meta, parts):
        return cls(parts)


def fit_vote(
    train: DataFrame,
    freq: str,
    members: Sequence[str] = MEMBERS,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    overrides: Mapping[str, dict] | None = None,
) -> VoteForecaster:
    """Fit every member on the same train rows; the tree ensembles among them share one stage."""
    overrides = overrides or {}
    trees = [m for m in members if m in ENSEMBLES]
    recipes = [ensemble_recipe(m, freq, **overrides.get(m, {})) for m in trees]
    fitted = dict(zip(trees, fit_ensembles(train, features, target, recipes) if trees else []))
    for m in members:
        if m not in fitted:
            fitted[m] = make_model(m, freq, features, target, **overrides.get(m, {}))(train)
    return VoteForecaster([fitted[m] for m in members])


def voting_forecast(
    df: DataFrame,
    freq: str,
    time_col: str,
    members: Sequence[str] = MEMBERS,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    overrides: Mapping[str, dict] | None = None,
) -> Evaluation:
    """Fit the vote on the train rows and score validation and test."""
    fit = lambda train: fit_vote(train, freq, members, features, target, overrides)
    return fit_and_evaluate(df, fit, time_col, "voting", freq, features, target)
