"""All fitted models side by side, at one frequency or at several."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import compare_models, score
from ..operators.ordered import profile
from ..operators.split import chronological_split
from ..schema import FEATURES, TARGET
from ..session import cut_lineage
from .arx import arx_forecast
from .naive import naive_forecast
from .shards import fit_ensembles
from .tabular import ENSEMBLES, ensemble_recipe, make_model
from .vote import MEMBERS

# Fixed value: what is ranked beside the naive forecast, the error model and the vote.
RANKED = (*MEMBERS, "random_forest", "linear")


def score_models(
    df: DataFrame,
    freq: str,
    time_col: str,
    algorithms: Sequence[str] = RANKED,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    overrides: Mapping[str, dict] | None = None,
    extra: bool = True,
) -> DataFrame:
    """``model, freq, split`` and scores of every algorithm with its registry parameters.

    The tree ensembles are grown in one stage. Every model adds a column to the held-out rows, which
    are then scored in one pass; the vote is the mean of those of its members that are there.
    ``extra`` adds the naive forecast and the regression with error model.
    """
    overrides = overrides or {}
    narrow = df.select(time_col, target, *features)
    prof = profile(narrow, time_col)
    split = cut_lineage(chronological_split(narrow, time_col, prof=prof))
    train, held = split.where("split = 'train'"), split.where("split <> 'train'")
    trees = [a for a in algorithms if a in ENSEMBLES]
    fitted = dict(zip(trees, fit_ensembles(train, features, target, [ensemble_recipe(a, freq, **overrides.get(a, {})) for a in trees]) if trees else []))
    for a in algorithms:
        if a not in fitted:
            fitted[a] = make_model(a, freq, features, target, **overrides.get(a, {}))(train)
    for i, a in enumerate(algorithms):
        held = fitted[a].transform(held).withColumnRenamed("prediction", f"__m{i}")
    columns = {a: F.col(f"__m{i}") for i, a in enumerate(algorithms)}
    votes = [columns[a] for a in MEMBERS if a in columns]
    if len(votes) > 1:
        columns["voting"] = sum(votes[1:], votes[0]) / len(votes)
    cells = [F.struct(F.lit(a).alias("model"), c.alias("predicted")) for a, c in columns.items()]
    long = held.select(time_col, F.col(target).cast("double").alias("actual"), "split", F.lit(freq).alias("freq"), F.explode(F.array(*cells)).alias("m"))
    found = score(long.select(time_col, "actual", "split", "freq", "m.*"), time_col, by=["model", "freq", "split"])
    if not extra:
        return found
    return found.unionByName(naive_forecast(df, time_col, freq, target)).unionByName(arx_forecast(df, freq, time_col, features=features, target=target).scores)


def rank_models(tables: Mapping[str, DataFrame], time_col: str, **how) -> DataFrame:
    """Scores and ranks of all models at every frequency; the frequencies run side by side."""
    names = list(tables)
    with ThreadPool(len(names)) as pool:
        parts = pool.map(lambda f: cut_lineage(score_models(tables[f], f, time_col, **how)), names)
    scores = parts[0]
    for part in parts[1:]:
        scores = scores.unionByName(part)
    return compare_models(scores)
