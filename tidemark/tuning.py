"""Time-ordered random search for tabular models and networks."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models.base import Evaluation, evaluate
from .models.network import EPOCHS, Net, _flat_windows, fit_network
from .models.registry import sample_network, sample_params
from .models.shards import Job, spaces, train_jobs
from .models.svr import SvrJob, SvrParams, train_svr
from .models.tabular import ENSEMBLES, ensemble_recipe, make_model, model_params
from .operators.ordered import profile
from .operators.scale import WINDOW, window_dataset
from .operators.split import chronological_split, fold_bounds
from .schema import CHANNELS, FEATURES, TARGET
from .session import cut_lineage


def random_search(
    df: DataFrame,
    algorithm: str,
    freq: str,
    time_col: str,
    n_iter: int = 10,
    n_splits: int = 5,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    candidates: Sequence[dict] | None = None,
    parallelism: int = 4,
    seed: int = 42,
) -> tuple[DataFrame, Evaluation]:
    """Mean squared error of sampled candidates over expanding folds of the train rows.

    Returns the candidate table (failures carry their error text) and the evaluation
    of the best candidate, refitted on all train rows. Tree ensembles of all candidates and
    folds are grown in one stage over one binned table, whose prefixes the folds are; support
    vector machines of all candidates and folds share their passes over the rows. Other
    candidates are independent Spark jobs submitted from a small thread pool.
    """
    narrow = df.select(time_col, target, *features)
    prof = profile(narrow, time_col)
    split = cut_lineage(chronological_split(narrow, time_col, prof=prof))
    train = split.filter(F.col("split") == "train")
    folds = fold_bounds(int(prof.rows * 0.6), n_splits)
    candidates = list(candidates or sample_params(algorithm, n_iter, seed))

    def run(at: int):
        try:
            fit, errors = make_model(algorithm, freq, features, target, **candidates[at]), []
            for train_end, test_end in folds:
                model = fit(train.filter(F.col("pos") < train_end))
                tested = model.transform(train.filter((F.col("pos") >= train_end) & (F.col("pos") < test_end)))
                miss = F.col("prediction") - F.col(target)
                errors.append(tested.agg(F.avg(miss * miss)).first()[0])
            return at, str(candidates[at]), float(sum(errors) / len(errors)), None
        except (ValueError, ArithmeticError, np.linalg.LinAlgError, IllegalArgumentException) as problem:
            # Parameters that do not fit are reported and the search goes on; anything else ends it.
            return at, str(candidates[at]), None, str(problem).splitlines()[0]

    if algorithm in ENSEMBLES:
        rows = _search_ensembles(train, algorithm, freq, features, target, candidates, folds)
    elif algorithm == "svr":
        rows = _search_svr(train, freq, features, target, candidates, folds)
    else:
        with ThreadPool(min(parallelism, len(candidates))) as pool:
            rows = pool.map(run, range(len(candidates)))
    done = [r for r in rows if r[2] is not None and math.isfinite(r[2])]
    if not done:
        raise RuntimeError(f"every candidate failed, e.g. {rows[0][3]}")
    best = min(done, key=lambda r: (r[2], r[0]))[0]
    table = df.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in rows], "candidate int, params string, mse double, error string, best boolean"
    )
    model = make_model(algorithm, freq, features, target, **candidates[best])(train)
    return table, evaluate(model, split, time_col, algorithm, freq, target, prof)


def _search_ensembles(train: DataFrame, algorithm: str, freq: str, features: Sequence[str], target: str, candidates: Sequence[dict], folds: Sequence[tuple[int, int]]) -> list[tuple]:
    """(candidate, parameters, mean squared error, problem) of every candidate, from one stage."""
    recipes, problems = {}, {}
    for i, candidate in enumerate(candidates):
        try:
            recipes[i] = ensemble_recipe(algorithm, freq, **candidate)
        except ValueError as problem:
            problems[i] = str(problem).splitlines()[0]
    kinds = list(dict.fromkeys((scale, pca, end) for _, scale, pca in recipes.values() for end, _ in folds))
    errors: dict[int, list[float]] = {i: [] for i in recipes}
    if recipes:
        jobs = [Job(params, kinds.index((scale, pca, end)), end, test_end) for params, scale, pca in recipes.values() for end, test_end in folds]
        known = train.where(F.col(target).isNotNull())
        found = train_jobs(known, features, target, jobs, spaces(known, features, kinds), "pos")
        for at, made in enumerate(found):
            errors[list(recipes)[at // len(folds)]].append(made["error"])
    mean = lambda i: float(sum(errors[i]) / len(folds)) if i in recipes else None
    return [(i, str(c), mean(i), problems.get(i)) for i, c in enumerate(candidates)]


def _search_svr(train: DataFrame, freq: str, features: Sequence[str], target: str, candidates: Sequence[dict], folds: Sequence[tuple[int, int]]) -> list[tuple]:
    """(candidate, parameters, mean squared error, problem) of every candidate, fitted together."""
    jobs, problems = {}, {}
    for i, candidate in enumerate(candidates):
        try:
            params = SvrParams(**model_params("svr", freq, **candidate))
            jobs[i] = [SvrJob(params, *fold) for fold in folds]
        except ValueError as problem:
            problems[i] = str(problem).splitlines()[0]
    found = train_svr(train, features, target, [j for made in jobs.values() for j in made], "pos") if jobs else []
    errors = {i: [e for _, e in found[at * len(folds) : (at + 1) * len(folds)]] for at, i in enumerate(jobs)}
    mean = lambda i: float(sum(errors[i]) / len(folds)) if i in jobs else None
    return [(i, str(c), mean(i), problems.get(i)) for i, c in enumerate(candidates)]


def nn_search(
    df: DataFrame,
    kind: str,
    freq: str,
    time_col: str,
    channels: Sequence[str] = CHANNELS,
    trials: int = 5,
    epochs: int = EPOCHS,
    window: int | None = None,
    candidates: Sequence[dict] | None = None,
    seed: int = 42,
    parallelism: int = 5,
) -> DataFrame:
    """Validation RMSE of sampled networks: ``trial, params, rmse``, best first.

    The table is read once and stored; networks are independent and trained from a small
    thread pool.
    """
    df = cut_lineage(df.select(time_col, *channels))
    windows, bounds = window_dataset(df, time_col, freq, channels, window=window)
    rows = cut_lineage(_flat_windows(windows))
    train, held = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "validation")
    length = window or WINDOW[freq]
    rng = random.Random(seed)
    candidates = list(candidates or [sample_network(rng) for _ in range(trials)])

    def run(at: int):
        p = candidates[at]
        net = Net(kind, length, len(bounds), tuple(p["units"]), tuple(p["activations"]), p["dropout"])
        _, history = fit_network(train, held, net, p["learning_rate"], epochs, seed=seed)
        return at, str(p), math.sqrt(min(history))

    with ThreadPool(min(parallelism, len(candidates))) as pool:
        found = pool.map(run, range(len(candidates)))
    table = df.sparkSession.createDataFrame(found, "trial int, params string, rmse double")
    return table.orderBy("rmse", "trial")
