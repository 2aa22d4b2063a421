"""Tree ensembles from histograms: slow twins, several tasks, searches, packed predictions."""

import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import tuning
from tidemark.models import growing, shards
from tidemark.models.growing import Binned, TreeParams
from tidemark.models.packed import Tables, Trees, combine, mapped, pack, unpack
from tidemark.models.ranking import rank_models
from tidemark.models.tabular import train_and_evaluate
from tidemark.operators.split import chronological_split, fold_bounds


def table(n=120, missing=0.0, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = 2 * (x[:, 0] > 0.3) + np.sin(2 * x[:, 1]) + 0.2 * rng.normal(size=n)
    if missing:
        y = y + 3 * (hidden := rng.random(n) < missing)
        x[hidden, 1] = np.nan
    return x, y, growing.mix(np.arange(n))


def edges_of(x):
    return [np.unique(c[~np.isnan(c)]) for c in x.T]


def alone(p, x, y, key):
    return shards.train_alone(growing.KINDS[p.kind](Binned(x, edges_of(x)), y, key, p))


def apart(p, x, y, key, tasks):
    """The same ensemble grown by several tasks that see each other's sums alone."""
    parts = [np.arange(len(y))[i::tasks] for i in range(tasks)]
    made = [growing.KINDS[p.kind](Binned(x[r], edges_of(x)), y[r], key[r], p) for r in parts]
    answer, done = [None] * tasks, [None] * tasks
    while True:
        asked = []
        for i, m in enumerate(made):
            try:
                asked.append(m.send(answer[i]))
            except StopIteration as end:
                done[i] = end.value
        if not asked:
            return done[0]
        total = (np.sum if asked[0][0] == "sum" else np.max)([a for _, a in asked], axis=0)
        answer = [total] * tasks


def predicted(made, x):
    return combine(made["ensemble"].leaves(x), made["how"], made["base"], made["weights"])


def slow_tree(x, g, rows, p, depth, w=None):
    """(best split or value) by trying every value of every column, missing values on both sides."""
    w = np.ones(len(g)) if w is None else w
    s = lambda r: (g[r].sum() ** 2 / (w[r].sum() + p.reg_lambda)) if w[r].sum() + p.reg_lambda > 0 else 0.0
    value = g[rows].sum() / (w[rows].sum() + p.reg_lambda)
    best = None
    if depth < p.depth and len(rows) >= p.min_split:
        for f in range(x.shape[1]):
            for t in [*np.unique(x[~np.isnan(x[:, f]), f]), math.inf]:
                for missing_left in (False, True) if np.isnan(x[rows, f]).any() else (True,):
                    goes = (x[rows, f] <= t) | (np.isnan(x[rows, f]) & missing_left)
                    left, right = rows[goes], rows[~goes]
                    if min(len(left), len(right)) < max(1, p.min_leaf) or min(w[left].sum(), w[right].sum()) < p.min_hessian:
                        continue
                    gain = s(left) + s(right) - s(rows)
                    if gain > max(2 * p.gamma, 1e-9) and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, t, missing_left, left, right)
    if best is None:
        return value
    _, f, t, missing_left, left, right = best
    return (f, t, missing_left, slow_tree(x, g, left, p, depth + 1, w), slow_tree(x, g, right, p, depth + 1, w))


def slow_value(tree, row):
    while isinstance(tree, tuple):
        f, t, missing_left, left, right = tree
        tree = left if row[f] <= t or (math.isnan(row[f]) and missing_left) else right
    return tree


def slow_boost(x, y, key, p):
    out = np.full(len(y), y.mean())
    for t in range(p.trees):
        rows = np.flatnonzero(growing.share(p.seed, 3, t, key) < p.row_share)
        tree = slow_tree(x, y - out, rows, p, 0)
        out = out + p.rate * np.array([slow_value(tree, r) for r in x])
    return out


@pytest.mark.parametrize(
    "p",
    [
        TreeParams(trees=4, rate=0.3, depth=3, min_leaf=5, min_split=15),
        TreeParams(trees=3, rate=0.3, depth=4, min_hessian=6.0, reg_lambda=2.0, gamma=0.4),
        TreeParams(trees=4, rate=0.5, depth=3, reg_lambda=1.0, row_share=0.7),
        TreeParams(trees=3, rate=0.3, depth=4, grow="leaf", leaves=10**6, min_leaf=4),
    ],
)
@pytest.mark.parametrize("missing", [0.0, 0.2])
def test_boosting_equals_a_greedy_search(p, missing):
    x, y, key = table(90, missing)
    made = alone(p, x, y, key)
    assert np.allclose(predicted(made, x), slow_boost(x, y, key, p), atol=1e-9)


def test_missing_values_learn_their_side():
    x = np.array([[1.0], [2.0], [3.0], [np.nan], [np.nan], [np.nan]])
    y = np.array([0.0, 0.0, 5.0, 5.0, 5.0, 5.0])
    made = alone(TreeParams(trees=1, rate=1.0, depth=1), x, y, growing.mix(np.arange(6)))
    assert np.allclose(predicted(made, np.array([[2.0], [9.0], [np.nan]])), [0.0, 5.0, 5.0])


def test_leaf_wise_growth_takes_the_best_leaf_first():
    x, y, key = table(200)
    made = alone(TreeParams(trees=1, rate=1.0, depth=30, grow="leaf", leaves=5), x, y, key)
    tree = made["ensemble"]
    leaves = (tree.left == np.arange(len(tree.left))).sum()
    assert leaves == 5
    whole = alone(TreeParams(trees=1, rate=1.0, depth=30), x, y, key)
    assert np.square(predicted(whole, x) - y).sum() < 1e-12 < np.square(predicted(made, x) - y).sum()


def slow_ordered(x, y, key, p):
    """Ordered boosting with every model kept apart, leaf by leaf."""
    n, base = len(y), y.mean()
    levels = max(1, math.ceil(math.log2(n)))
    place = growing.share(p.seed, 5, key)
    level = np.array([min(levels - 1, max(0, math.floor(math.log2(u)) + levels)) for u in place])
    models = np.full((levels + 1, n), base)
    for _ in range(p.trees):
        g = np.array([y[i] - models[level[i], i] for i in range(n)])
        leaf, splits = np.zeros(n, int), 0
        score = lambda ids: sum(g[ids == k].sum() ** 2 / ((ids == k).sum() + p.reg_lambda) for k in np.unique(ids))
        for _ in range(p.depth):
            best, now = None, score(leaf)
            for f in range(x.shape[1]):
                for t in np.unique(x[:, f]):
                    right = x[:, f] > t
                    if right.any() and (best is None or score(2 * leaf + right) > best[0] + 1e-9):
                        best = (score(2 * leaf + right), right)
            if best is None or best[0] - now <= 1e-9:
                break
            leaf, splits = 2 * leaf + best[1], splits + 1
        for j in range(levels + 1):
            mine = level < j if j < levels else np.ones(n, bool)
            step = {k: p.rate * (y - models[j])[mine & (leaf == k)].sum() / ((mine & (leaf == k)).sum() + p.reg_lambda) for k in np.unique(leaf)}
            models[j] = models[j] + np.array([step[k] for k in leaf])
    return models[levels]


def test_ordered_boosting_equals_its_slow_twin():
    x, y, key = table(70)
    p = TreeParams(kind="ordered", trees=4, rate=0.3, depth=3, reg_lambda=2.0)
    made = alone(p, x, y, key)
    assert isinstance(made["ensemble"], Tables) and np.allclose(predicted(made, x), slow_ordered(x, y, key, p), atol=1e-9)
    # A missing value goes left, and a tree that ends early keeps its leaves in place.
    flat = alone(TreeParams(kind="ordered", trees=2, depth=6, reg_lambda=1.0), x[:, :1] > 0.3, y, key)
    assert np.isfinite(predicted(flat, np.array([[np.nan], [1.0]]))).all()


@pytest.mark.parametrize(
    "p",
    [
        TreeParams(trees=6, rate=0.2, depth=4, min_leaf=3, reg_lambda=1.0, row_share=0.8, column_share=0.7),
        TreeParams(trees=4, rate=0.2, depth=9, grow="leaf", leaves=12, min_leaf=3),
        TreeParams(kind="ordered", trees=6, rate=0.2, depth=3, reg_lambda=3.0),
        TreeParams(kind="adaboost", trees=6, rate=0.5, depth=3),
        TreeParams(kind="forest", trees=5, depth=6, min_leaf=2, node_columns="sqrt"),
    ],
    ids=["level", "leaf", "ordered", "adaboost", "forest"],
)
def test_tasks_make_no_difference(p):
    x, y, key = table(300, 0.1 if p.kind == "boost" else 0.0)
    one = alone(p, x, y, key)
    for tasks in (2, 4):
        other = apart(p, x, y, key, tasks)
        assert np.allclose(predicted(one, x), predicted(other, x), atol=1e-9)
        assert all(np.array_equal(a, b) for n, a in one["ensemble"].arrays().items() if n in ("feature", "threshold", "left") for b in [other["ensemble"].arrays()[n]])


def test_pieces_of_a_forest_are_the_forest():
    x, y, key = table()
    p = TreeParams(kind="forest", trees=7, depth=5, node_columns=1)
    whole = alone(p, x, y, key)
    parts = shards.joined([alone(q, x, y, key) for q in shards.pieces(p, 3)])
    assert [q.trees for q in shards.pieces(p, 3)] == [2, 2, 3]
    assert np.array_equal(predicted(whole, x), predicted(parts, x))
    again = Trees(**unpack(pack(**whole["ensemble"].arrays())))
    assert np.array_equal(again.leaves(x), whole["ensemble"].leaves(x))


@pytest.fixture(scope="module")
def rows(spark):
    x, y, _ = table(160)
    return spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "pos bigint, a double, b double, c double, y double").persist()


def test_a_barrier_stage_grows_the_same_trees(rows):
    """Three tasks of one barrier stage against one task; the plan holds one function for all trees."""
    p = TreeParams(trees=2, rate=0.5, depth=2)
    one = shards.fit_ensemble(rows, ["a", "b", "c"], "y", p, True, 2)
    many = shards.fit_ensemble(rows, ["a", "b", "c"], "y", p, True, 2, rows_per_task=60)
    assert np.array_equal(one.ensemble.threshold, many.ensemble.threshold) and np.allclose(one.ensemble.value, many.ensemble.value, atol=1e-12)
    x = rows.orderBy("pos").select("a", "b", "c").toPandas().to_numpy()
    assert np.allclose([r.prediction for r in many.transform(rows).orderBy("pos").collect()], one.predict(x))
    plans = [m.transform(rows)._jdf.queryExecution().optimizedPlan().toString().count("\n") for m in (one, shards.fit_ensemble(rows, ["a", "b", "c"], "y", TreeParams(trees=40, depth=2), True, 2))]
    assert plans[0] == plans[1]


def test_a_failed_task_restarts_the_stage(rows, monkeypatch):
    """One task dies in its first attempt; the barrier stage runs again with equal trees."""
    mark = os.path.join(tempfile.mkdtemp(prefix="tidemark-fail-"), "failed")
    kept = growing.KINDS["boost"]

    def once(*args):
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("lost on purpose")
        return (yield from kept(*args))

    p = TreeParams(trees=1, rate=0.5, depth=2)
    wanted = shards.fit_ensemble(rows, ["a", "b", "c"], "y", p)
    monkeypatch.setitem(growing.KINDS, "boost", once)
    try:
        got = shards.fit_ensemble(rows, ["a", "b", "c"], "y", p, rows_per_task=60)
    except Exception as problem:  # a local master allows no second attempt of a task
        assert os.path.exists(mark) and "lost on purpose" in str(problem)
        got = shards.fit_ensemble(rows, ["a", "b", "c"], "y", p, rows_per_task=60)
    assert np.array_equal(wanted.ensemble.threshold, got.ensemble.threshold)


@pytest.mark.parametrize("algorithm,candidates", [("xgboost", [{"n_estimators": 6, "max_depth": 3, "pca": 3}, {"n_estimators": 4, "max_depth": 2, "pca": 4}]), ("random_forest", [{"n_estimators": 9, "max_depth": 5}])])
def test_search_in_one_stage_equals_separate_fits(spark, algorithm, candidates):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 4))
    y = x[:, 0] + np.abs(x[:, 1]) + 0.1 * rng.normal(size=150)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "ts bigint, a double, b double, c double, d double, y double")
    found, _ = tuning.random_search(df, algorithm, "D", "ts", n_splits=2, features=names, target="y", candidates=candidates)
    got = {r["candidate"]: r["mse"] for r in found.collect()}
    train = chronological_split(df, "ts").where("split = 'train'").persist()
    for i, c in enumerate(candidates):
        errors = []
        for end, test_end in fold_bounds(90, 2):
            model = tuning.make_model(algorithm, "D", names, "y", **c)(train.where(F.col("pos") < end))
            held = model.transform(train.where((F.col("pos") >= end) & (F.col("pos") < test_end)))
            errors.append(held.agg(F.avg(F.pow(F.col("prediction") - F.col("y"), 2))).first()[0])
        assert math.isclose(got[i], sum(errors) / 2, rel_tol=1e-9)


def test_odd_tables(spark):
    p = TreeParams(trees=3, depth=3, min_leaf=1)
    same = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, y double")
    assert np.allclose(shards.fit_ensemble(same, ["a"], "y", p).predict(np.array([[7.0], [np.nan]])), 2.0)
    holes = spark.createDataFrame([(None, 1.0), (None, 3.0), (2.0, None)], "a double, y double")
    assert np.allclose(shards.fit_ensemble(holes, ["a"], "y", p).predict(np.array([[7.0]])), 2.0)
    for bad in ({"trees": 0}, {"depth": 0}, {"kind": "ordered", "depth": 17}, {"rate": 0.0}, {"row_share": 0.0}):
        with pytest.raises(ValueError):
            TreeParams(**bad)


def test_mapped_does_not_depend_on_batches():
    rng = np.random.default_rng(4)
    x, m, o = rng.normal(size=(1000, 4)), rng.normal(size=(4, 3)), rng.normal(size=3)
    whole = mapped(x, m, o)
    assert np.allclose(whole, x @ m + o) and np.array_equal(whole[17:18], mapped(x[17:18], m, o))


def test_ranking_scores_every_model_as_it_does_alone(spark):
    x, y, _ = table(150)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "ts bigint, a double, b double, c double, y double")
    names, small = ["a", "b", "c"], {"catboost": {"iterations": 5, "depth": 2}, "xgboost": {"n_estimators": 4, "max_depth": 2, "pca": 3}}
    got = rank_models({f: df for f in "DW"}, "ts", algorithms=["catboost", "xgboost", "linear_raw"], features=names, target="y", overrides=small, extra=False).collect()
    assert {(r["model"], r["freq"]) for r in got} == {(m, f) for m in ("catboost", "xgboost", "linear_raw", "voting") for f in "DW"}
    for r in got:
        if r["model"] != "voting" and r["freq"] == "D":
            alone = {s["split"]: s for s in train_and_evaluate(df, r["model"], "D", "ts", names, "y", **small.get(r["model"], {})).scores.collect()}
            assert math.isclose(r["RMSE"], alone[r["split"]]["RMSE"], rel_tol=1e-9) and math.isclose(r["MASE"], alone[r["split"]]["MASE"], rel_tol=1e-9)
    for f in "DW":
        for split in ("validation", "test"):
            some = sorted((r for r in got if r["freq"] == f and r["split"] == split), key=lambda r: r["rank"])
            assert [r["rank"] for r in some] == [1, 2, 3, 4] and [r["MAE"] for r in some] == sorted(r["MAE"] for r in some)
