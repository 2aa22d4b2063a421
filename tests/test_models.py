import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import series
from tidemark import tuning
from tidemark.models import registry
from tidemark.models.adaboost import fit_adaboost
from tidemark.models.arx import ErrorModel, arx_forecast, order_grid_search, stable
from tidemark.models.base import fit_and_evaluate, load_model, save_model
from tidemark.models.naive import naive_forecast
from tidemark.models.network import Net, fit_network, mean_squared_error, window_forecast
from tidemark.models.svr import fit_svr
from tidemark.models.packed import mapped
from tidemark.models.tabular import feature_importance, make_model, train_and_evaluate
from tidemark.models.vote import fit_vote
from tidemark.operators.scale import WINDOW, window_dataset
from tidemark.schema import FEATURES, TARGET
from tidemark.session import new_path

NOISE = (np.sin(np.arange(1, 6000) * 12.9898) * 43758.5453) % 1.0 - 0.5


@pytest.fixture(scope="module")
def signal(spark, frame):
    """Target = 3 no2 - 2 o3 + 1 + a little noise; the other two features are noise."""
    base = frame(series(300, step=86400, fn=lambda i: 0)).select(F.col("ts").alias("start_ts"))
    rows = []
    for i, r in enumerate(base.orderBy("start_ts").collect()):
        a, b, c, d = (float(NOISE[i * 5 + j]) for j in range(4))
        rows.append((r.start_ts, 3 * a - 2 * b + 1 + 0.05 * float(NOISE[i * 5 + 4]), a, b, c, d))
    schema = "start_ts timestamp, " + ", ".join(f"{c} double" for c in (TARGET, *FEATURES))
    return spark.createDataFrame(rows, schema).cache()


def mean_error(df, evaluation):
    """MSE of the train mean on the test rows."""
    held = evaluation.predictions.filter("split = 'test'")
    mean = df.orderBy("start_ts").limit(180).agg(F.avg(TARGET)).first()[0]
    return held.agg(F.avg(F.pow(F.col("actual") - mean, 2))).first()[0]


SMALL = {
    "linear": {},
    "linear_raw": {},
    "svr": {"max_iter": 10},
    "gradient_boosting": {"n_estimators": 10, "max_depth": 3},
    "histogram_gradient_boosting": {"max_iter": 10, "max_depth": 3, "min_samples_leaf": 5, "learning_rate": 0.2},
    "xgboost": {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.3},
    "adaboost": {"n_estimators": 5, "max_depth": 4},
    "catboost": {"iterations": 10, "depth": 3},
    "random_forest": {"n_estimators": 10, "max_depth": 6},
    "random_forest_raw": {"n_estimators": 10, "max_depth": 6},
}


@pytest.mark.parametrize("algorithm", SMALL)
def test_learners_beat_the_mean(signal, algorithm):
    made = train_and_evaluate(signal, algorithm, "D", "start_ts", **SMALL[algorithm])
    scores = {r.split: r for r in made.scores.collect()}
    assert set(scores) == {"validation", "test"}
    assert scores["test"].MSE < 0.6 * mean_error(signal, made)


def test_unknown_names():
    with pytest.raises(ValueError):
        make_model("nothing", "D")
    with pytest.raises(ValueError):
        registry.best_params("svr", "Q")
    with pytest.raises(ValueError):
        registry.best_params("nothing", "D")
    with pytest.raises(ValueError):
        registry.param_space("nothing")


def test_registry(spark):
    assert registry.best_params("sarimax", "D")["order"] == (6, 0, 1)
    assert registry.best_params("xgboost", "M")["n_estimators"] == 205
    changed = registry.best_params("dnn", "M")
    changed["units"].append(1)
    assert registry.best_params("dnn", "M")["units"] == [32, 32]
    for kind in ("dnn", "lstm", "cnn"):
        for f in "HDWM":
            p = registry.best_params(kind, f)
            assert len(p["units"]) == len(p["activations"])
    assert registry.best_params_table(spark).filter("model = 'svr' and freq = 'H'").count() == 4


def test_samples_are_repeatable_and_in_range():
    for model in registry.PARAM_SPACES:
        a, b = registry.sample_params(model, 5), registry.sample_params(model, 5)
        assert a == b and len(a) == 5
    assert all(3 <= p["pca"] <= 4 for p in registry.sample_params("xgboost", 20))


@pytest.mark.parametrize("algorithm", ["linear", "svr", "adaboost", "random_forest"])
def test_saved_model_predicts_the_same(spark, signal, algorithm):
    made = train_and_evaluate(signal, algorithm, "D", "start_ts", **SMALL[algorithm])
    path = new_path(spark, "model")
    save_model(spark, made.model, path)
    save_model(spark, made.model, path)
    a = [r.prediction for r in made.model.transform(signal).orderBy("start_ts").collect()]
    b = [r.prediction for r in load_model(spark, path).transform(signal).orderBy("start_ts").collect()]
    assert np.allclose(a, b, atol=1e-12)


def test_vote_is_the_mean_and_survives_saving(spark, signal):
    members = ("linear_raw", "svr", "catboost")
    vote = fit_vote(signal, "D", members, overrides=SMALL)
    each = np.mean([[r.prediction for r in m.transform(signal).orderBy("start_ts").collect()] for m in vote.members], axis=0)
    both = [r.prediction for r in vote.transform(signal).orderBy("start_ts").collect()]
    assert np.allclose(each, both)
    path = new_path(spark, "vote")
    save_model(spark, vote, path)
    again = [r.prediction for r in load_model(spark, path).transform(signal).orderBy("start_ts").collect()]
    assert np.allclose(both, again)


def svr_loss(x, y, w, b, C, eps):
    return 0.5 * w @ w + C * np.maximum(np.abs(y - x @ w - b) - eps, 0).sum()


def test_svr_reaches_the_optimum(spark):
    x = NOISE[:160].reshape(80, 2) * 4
    y = x @ [1.5, -0.5] + 0.3 + 0.4 * NOISE[500:580]
    y[::10] += 5
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, y double")
    made = fit_svr(df, ["a", "b"], "y", C=1.0, epsilon=0.1, kernel="linear", gamma=1.0, max_iter=40, pca=2)
    p = np.asarray([r.prediction for r in made.transform(df).collect()])
    z = np.linalg.lstsq(np.column_stack([x, np.ones(80)]), p, rcond=None)[0]
    scaled = (x - x.mean(0)) / x.std(0)
    got = svr_loss(scaled, y, z[:2] * x.std(0), z[2] + z[:2] @ x.mean(0), 1.0, 0.1)
    # Subgradient descent on the same objective, best value met.
    w, b, best = np.zeros(2), np.median(y), math.inf
    for k in range(20000):
        r = y - scaled @ w - b
        s = np.sign(r) * (np.abs(r) > 0.1)
        w, b = w - 0.02 / math.sqrt(k + 1) * (w - scaled.T @ s), b + 0.02 / math.sqrt(k + 1) * s.sum()
        best = min(best, svr_loss(scaled, y, w, b, 1.0, 0.1))
    assert got <= best * 1.01


def test_rbf_learns_a_curve(spark):
    x = np.linspace(-2, 2, 200)
    rows = [(float(v), float(u), float(math.sin(2 * v))) for v, u in zip(x, NOISE[:200])]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    made = fit_svr(df, ["a", "b"], "y", C=10.0, epsilon=0.01, kernel="rbf", gamma=1.0)
    error = made.transform(df).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert error < 0.15
    with pytest.raises(ValueError):
        fit_svr(df, ["a"], "y", C=1.0, epsilon=0.1, kernel="other", gamma=1.0)


def test_adaboost_median_and_weights(signal):
    model = fit_adaboost(signal, FEATURES, TARGET, n_estimators=12, learning_rate=0.5, max_depth=2)
    assert len(model.ensemble.root) == len(model.weights) and (model.weights > 0).all()
    rows = signal.orderBy("start_ts").toPandas()
    leaves = model.ensemble.leaves(mapped(rows[list(FEATURES)].to_numpy(float), model.matrix, model.offset))
    got = [r.prediction for r in model.transform(signal).orderBy("start_ts").collect()]
    for votes, prediction in zip(leaves, got):
        order = np.argsort(votes, kind="stable")
        run = np.cumsum(model.weights[order])
        assert np.isclose(prediction, votes[order][np.argmax(run >= 0.5 * run[-1])])


def test_naive_forecast(spark, signal):
    got = {r.split: r for r in naive_forecast(signal, "start_ts", "D").collect()}
    y = [r[TARGET] for r in signal.orderBy("start_ts").collect()]
    miss = np.abs(np.diff(y))[int(299 * 0.6) : int(299 * 0.6) + int(299 * 0.2)]
    assert np.isclose(got["validation"].MAE, miss.mean())


def test_feature_importance_finds_the_signal(signal):
    got = [r.feature for r in feature_importance(signal, "start_ts", top=2, trees=10, max_depth=6).collect()]
    assert got == ["no2_value", "o3_value"]


def arima_path(phi, theta, d, n):
    eta, shock = np.zeros(n), NOISE[1000 : 1000 + n]
    for t in range(n):
        eta[t] = shock[t] + sum(p * eta[t - i - 1] for i, p in enumerate(phi) if t > i)
        eta[t] += sum(q * shock[t - j - 1] for j, q in enumerate(theta) if t > j)
    for _ in range(d):
        eta = np.cumsum(eta)
    return eta


def make_arx(spark, eta):
    n = len(eta)
    x = NOISE[3000 : 3000 + n]
    base = series(n, step=86400, fn=lambda i: 2 * x[i] + 5 + eta[i])
    rows = [(t, v, float(x[i])) for i, (t, v) in enumerate(base)]
    return spark.createDataFrame(rows, f"start_ts timestamp, {TARGET} double, x double")


@pytest.mark.parametrize("order", [(1, 0, 0), (2, 0, 0), (1, 0, 1)])
def test_arx_recovers_parameters(spark, path, order):
    p, d, q = order
    phi, theta = [[], [0.7], [0.5, 0.2]][p], [[], [0.4]][q]
    df = make_arx(spark, arima_path(phi, theta, d, 1500))
    model = arx_forecast(df, "D", "start_ts", features=["x"], order=order).model
    assert np.allclose(model.beta, [2.0], atol=0.15)
    assert np.allclose(model.error.phi, phi, atol=0.12)
    assert np.allclose(model.error.theta, theta, atol=0.15)


def test_arx_with_difference_follows_a_trend(spark):
    df = make_arx(spark, 0.5 * np.arange(200) + 0.01 * NOISE[:200])
    made = arx_forecast(df, "D", "start_ts", features=["x"], order=(0, 1, 0))
    assert all(r.MAE < 0.2 for r in made.scores.collect())
    wide = made.model.interval(made.predictions.sparkSession.createDataFrame([(1.0, 120 + h) for h in range(5)], "x double, pos long"))
    rows = [r.upper - r.lower for r in wide.orderBy("pos").collect()]
    assert all(b > a for a, b in zip(rows, rows[1:]))


def test_error_model_jumps_agree_with_steps():
    model = ErrorModel([0.6, 0.2], [0.3], 1, 0.05, 1.5, [0.4, -0.1, 0.2, 7.0, 1.0])
    h = np.arange(1, 200)
    step, level, enters = model.system()
    state, cover, want, var = np.asarray(model.state), np.zeros(step.shape), [], []
    for _ in h:
        want.append(level @ state)
        var.append(model.sigma**2 * (1 + level @ cover @ level))
        state, cover = step @ state, step @ cover @ step.T + np.outer(enters, enters)
    assert np.allclose(model.forecast(h), want) and np.allclose(model.variance(h), var)
    some = np.asarray([150, 3, 77, 3])
    assert np.allclose(model.forecast(some), np.asarray(want)[some - 1])
    assert np.allclose(model.variance(some), np.asarray(var)[some - 1])


def test_unstable_autoregression_is_pulled_in():
    phi = stable(np.asarray([1.4, 0.2]))
    assert np.abs(np.roots([1, *-phi])).max() < 1


def test_order_grid_prefers_the_right_difference(spark):
    df = make_arx(spark, 0.5 * np.arange(300) + 0.2 * NOISE[:300])
    got = order_grid_search(df, "start_ts", 1, 1, 1, features=["x"])
    rows = got.collect()
    assert len(rows) == 8 and rows[0].d == 1
    one = arx_forecast(df, "D", "start_ts", features=["x"], order=(1, 1, 0)).scores.filter("split = 'validation'").first()
    same = [r.MAE for r in rows if (r.p, r.d, r.q) == (1, 1, 0)][0]
    assert np.isclose(one.MAE, same, rtol=0.1)


@pytest.mark.parametrize("kind", ["dnn", "cnn", "lstm"])
@pytest.mark.parametrize("act", ["tanh", "relu"])
def test_network_gradient(kind, act):
    net = Net(kind, 4, 3, (5, 4), (act, "tanh"))
    rng = np.random.default_rng(0)
    flat = net.initial() + 0.1 * rng.normal(size=net.size())
    x, y = rng.normal(size=(6, 4, 3)), rng.normal(size=(6, 3))
    loss = lambda f: float(((net.predict(f, x) - y) ** 2).mean())
    grad = net.gradient(flat, x, y, rng)
    for i in rng.choice(net.size(), 25, replace=False):
        e = np.zeros(net.size())
        e[i] = 1e-6
        assert np.isclose(grad[i], (loss(flat + e) - loss(flat - e)) / 2e-6, atol=1e-6)


def test_network_learns_a_wave(spark, frame):
    df = frame(series(400, fn=lambda i: math.sin(2 * math.pi * i / 24)), f"start_ts timestamp, {TARGET} double")
    made = window_forecast(
        df, "dnn", "H", "start_ts", channels=[TARGET], epochs=8, shards=2, units=[32], activations=["tanh"],
        dropout=False, learning_rate=0.01,
    )
    history = made.model.history
    assert min(history) < 0.5 * history[0]
    scores = {r.split: r for r in made.scores.collect()}
    assert scores["test"].MAE < 0.5
    path = new_path(spark, "net")
    save_model(spark, made.model, path)
    windows, _ = window_dataset(df, "start_ts", "H", [TARGET])
    flat = windows.withColumn("x", F.flatten("x"))
    a = [r.prediction for r in made.model.transform(flat).orderBy("pos").collect()]
    b = [r.prediction for r in load_model(spark, path).transform(flat).orderBy("pos").collect()]
    assert np.allclose(a, b)


def test_early_stop_and_best_weights(spark, frame):
    df = frame(series(120, fn=lambda i: NOISE[i]), f"start_ts timestamp, {TARGET} double")
    windows, bounds = window_dataset(df, "start_ts", "H", [TARGET])
    rows = windows.withColumn("x", F.flatten("x")).cache()
    train, held = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    net = Net("dnn", WINDOW["H"], len(bounds), (16,), ("tanh",))
    flat, history = fit_network(train, held, net, 0.05, epochs=6, patience=1, shards=2)
    assert np.isclose(mean_squared_error(held, net, flat), min(history))


def test_random_search_reports_failures(signal):
    candidates = [{"iterations": 5, "depth": 2}, {"iterations": 5, "depth": 99}]
    table, best = tuning.random_search(signal, "catboost", "D", "start_ts", n_splits=2, candidates=candidates)
    rows = {r.candidate: r for r in table.collect()}
    assert rows[0].best and rows[0].error is None
    assert rows[1].mse is None and rows[1].error
    assert best.scores.count() == 2


def test_fit_sees_train_rows_only(signal):
    seen = []
    fit = make_model("linear", "D")
    fit_and_evaluate(signal, lambda train: seen.append(train.count()) or fit(train), "start_ts", "m", "D")
    assert seen == [180]


def test_queries_keep_the_registry_settings(spark, monkeypatch):
    import __spark_entry__ as entry
    from tidemark.plans import forecast

    class Asked(Exception):
        pass

    def ask(*args, **kw):
        raise Asked(kw)

    monkeypatch.setattr(forecast, "_table", lambda spark, sf_dir: None)
    for place, name in ((forecast, "train_and_evaluate"), (forecast, "voting_forecast"), (forecast, "window_forecast"), (tuning, "random_search"), (tuning, "nn_search")):
        monkeypatch.setattr(place, name, ask)
    names = {*forecast.QUERY_NAMES.values(), "svr_forecast_rbf", "voting_forecast", "random_search", "random_search_svr", "nn_search"}
    for name in names | {f"{kind}_window_forecast" for kind in ("dnn", "cnn", "lstm")}:
        with pytest.raises(Asked) as asked:
            entry.queries()[name](spark, "")
        assert asked.value.args == ({},), name
