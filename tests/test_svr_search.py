"""Support vector machines of a search share their passes over the rows."""

import numpy as np
import pytest
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidemark.models import svr
from tidemark.models.svr import SvrJob, SvrParams, fit_svr, train_svr
from tidemark.tuning import random_search

CANDIDATES = [
    {"C": 1.0, "epsilon": 0.1, "kernel": "linear", "gamma": 1.0, "max_iter": 4},
    {"C": 10.0, "epsilon": 0.01, "kernel": "rbf", "gamma": 0.1, "max_iter": 5, "components": 20},
    {"C": 1.0, "epsilon": 0.1, "kernel": "other", "gamma": 1.0},
]


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(5).normal(size=(120, 2))
    return spark.createDataFrame([(i, float(a), float(b), float(2 * a - b + 0.1 * np.sin(9 * i))) for i, (a, b) in enumerate(x)], "pos long, a double, b double, y double")


@pytest.mark.parametrize("rows_per_task", [1_000_000, 50])
def test_models_trained_together_equal_those_trained_alone(table, rows_per_task):
    jobs = [SvrJob(SvrParams(**c), 80, 100) for c in CANDIDATES[:2]]
    for (model, error), job, c in zip(train_svr(table, ["a", "b"], "y", jobs, "pos", rows_per_task), jobs, CANDIDATES):
        alone = fit_svr(table.where("pos < 80"), ["a", "b"], "y", **c)
        assert np.allclose(model.beta, alone.beta) and np.isclose(model.intercept, alone.intercept)
        made = alone.transform(table.where("pos >= 80 and pos < 100")).agg(F.avg(F.pow(F.col("prediction") - F.col("y"), 2))).first()[0]
        assert np.isclose(error, made)


def test_search_takes_the_passes_of_its_slowest_model(table, monkeypatch):
    passes, real = [], svr._sums
    monkeypatch.setattr(svr, "_sums", lambda *a: passes.append(a[2]) or real(*a))
    found, _ = random_search(table, "svr", "D", "pos", n_splits=3, features=["a", "b"], target="y", candidates=CANDIDATES)
    rows = {r["candidate"]: r for r in found.collect()}
    assert rows[0]["mse"] < 1.0 and rows[1]["mse"] < 5.0 and "unknown kernel" in rows[2]["error"]
    # The search and the fit of the best model: two passes a step, and one before and one after.
    assert len(passes) <= 2 * (2 * 5 + 2)


def test_monomials_are_those_of_spark(spark):
    x = np.array([[2.0, 3.0, 5.0]])
    df = spark.createDataFrame([(Vectors.dense(x[0]),)], ["x"])
    want = PolynomialExpansion(degree=3, inputCol="x", outputCol="z").transform(df).first()["z"].toArray()
    assert np.allclose(svr._monomials(x)[0], want)
