"""Models of many series at once."""

import numpy as np
import pytest

from tidemark.models.panel import ar1_predictions_per_key, arx_forecast_ar1_per_key, fit_linear_per_key, linear_forecast_per_key, linear_predictions_per_key
from tidemark.models.tabular import train_and_evaluate

SCHEMA = "key string, ts bigint, a double, b double, y double"


def rows(key, n, slope, seed):
    rng = np.random.default_rng(seed)
    x, e = rng.normal(size=(n, 2)), 0.0
    out = []
    for i in range(n):
        e = 0.8 * e + 0.1 * rng.normal()
        out.append((key, i, float(x[i, 0]), float(x[i, 1]), float(1 + slope * x[i, 0] - x[i, 1] + e)))
    return out


@pytest.fixture(scope="module")
def panel(spark):
    # One key holds most rows; others are short, null or degenerate.
    data = rows("big", 300, 2.0, 1) + rows("small", 40, -3.0, 2) + rows(None, 30, 5.0, 3)
    data += [("flat", i, 1.0, 2.0, float(i)) for i in range(10)] + [("one", 0, 1.0, 2.0, 3.0), ("holes", 0, None, 1.0, 1.0), ("holes", 1, 1.0, 1.0, None)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def test_coefficients_equal_least_squares_of_each_key(panel):
    got = {r["key"]: r for r in fit_linear_per_key(panel, ["key"], ["a", "b"], "y").collect()}
    assert set(got) == {"big", "small", None, "flat", "one"}
    pdf = panel.toPandas()
    for key in ("big", "small", None):
        g = pdf[pdf["key"].isna()] if key is None else pdf[pdf["key"] == key]
        want = np.linalg.lstsq(np.c_[g[["a", "b"]].to_numpy(), np.ones(len(g))], g["y"].to_numpy(), rcond=None)[0]
        assert np.allclose([*got[key]["coefficients"], got[key]["intercept"]], want) and got[key]["rows"] == len(g)
    assert got["flat"]["coefficients"] == [0.0, 0.0] and got["flat"]["intercept"] == 4.5
    assert got["one"]["intercept"] == 3.0


def test_repeated_features_share_the_smallest_coefficients(spark):
    df = spark.createDataFrame([("k", i, float(i), float(i), 4.0 * i) for i in range(9)], SCHEMA)
    (row,) = fit_linear_per_key(df, ["key"], ["a", "b"], "y").collect()
    assert np.allclose(row["coefficients"], [2.0, 2.0])


def test_a_key_alone_equals_the_single_model(spark, panel):
    one = panel.where("key = 'big'")
    alone = {r["split"]: r for r in train_and_evaluate(one.drop("key"), "linear", "D", "ts", ["a", "b"], "y", pca=None).scores.collect()}
    many = {r["split"]: r for r in linear_forecast_per_key(panel, "D", "ts", ["key"], ["a", "b"], "y").where("key = 'big'").collect()}
    assert all(np.isclose(alone[s]["RMSE"], many[s]["RMSE"]) and np.isclose(alone[s]["MASE"], many[s]["MASE"]) for s in ("validation", "test"))


def test_errors_fade_by_their_coefficient(panel):
    lined = linear_predictions_per_key(panel, "ts", ["key"], ["a", "b"], "y").where("key = 'small'").orderBy("pos").toPandas()
    made = ar1_predictions_per_key(panel, "ts", ["key"], ["a", "b"], "y").where("key = 'small'").orderBy("pos").toPandas()
    train = lined[lined["split"] == "train"]
    v = (train["actual"] - train["predicted"]).to_numpy()
    phi = (v[1:] @ v[:-1]) / (v[:-1] @ v[:-1])
    want = lined["predicted"].to_numpy().copy()
    ahead = np.arange(1, len(lined) - len(v) + 1)
    want[len(v) :] += phi**ahead * v[-1]
    assert np.allclose(made["predicted"], want)
    scores = arx_forecast_ar1_per_key(panel, "D", "ts", ["key"], ["a", "b"], "y").collect()
    assert {r["key"] for r in scores} == {"big", "small", None, "flat", "one", "holes"}


def test_empty_panel(panel):
    assert linear_forecast_per_key(panel.limit(0), "D", "ts", ["key"], ["a", "b"], "y").count() == 0
    assert arx_forecast_ar1_per_key(panel.limit(0), "D", "ts", ["key"], ["a", "b"], "y").count() == 0


def exchanges(spark, frame):
    """Exchanges by hash in a plan whose joins may not broadcast."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = frame()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_rows_stay_with_their_series(spark, panel):
    # One exchange of the rows for the fit and one for all after it, and one of the models.
    assert exchanges(spark, lambda: linear_forecast_per_key(panel, "D", "ts", ["key"], ["a", "b"], "y")) <= 3


def test_errors_stay_with_their_series(spark, panel):
    assert exchanges(spark, lambda: arx_forecast_ar1_per_key(panel, "D", "ts", ["key"], ["a", "b"], "y")) <= 5
