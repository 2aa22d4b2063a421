import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import series
from tidemark.operators import metrics, scale, split, stats, timestats

NOISE = (np.sin(np.arange(1, 3000) * 12.9898) * 43758.5453) % 1.0 - 0.5


def test_describe_equals_pandas(spark, frame, path):
    rows = series(200, fn=lambda i: NOISE[i])
    got = stats.describe(frame(rows), ["value"]).first()
    want = pd.Series([v for _, v in rows]).describe()
    assert np.allclose([got[c] for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")], want)


def test_describe_needs_numbers(spark):
    with pytest.raises(ValueError):
        stats.describe(spark.createDataFrame([("a",)], "s string"))


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    got = {(r.col_a, r.col_b): r.r for r in stats.correlation_matrix(df).collect()}
    assert np.isclose(got["a", "b"], 1.0) and got["a", "c"] is None and got["c", "c"] is None and got["a", "a"] == 1.0


def test_histogram_edges_and_flat_column(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(31)], "a double, b double")
    got = stats.histogram(df).toPandas()
    want, edges = np.histogram(np.arange(31.0), bins=15)
    a = got[got.column == "a"].sort_values("bin")
    assert a["count"].tolist() == want.tolist() and np.allclose(a.bin_end, edges[1:])
    assert got[(got.column == "b") & (got.bin == 0)]["count"].tolist() == [31]


def test_kde_integrates_to_one(spark, frame):
    got = stats.kde(frame(series(300, fn=lambda i: NOISE[i])), "value").orderBy("point").toPandas()
    assert abs(np.trapezoid(got.density, got.x) - 1) < 0.01


def test_box_stats(spark, frame, path):
    got = stats.box_stats(frame(series(100, fn=lambda i: 1000 if i == 99 else i)), "value").first()
    assert (got.whisker_low, got.whisker_high, got.n_fliers, got.median) == (0.0, 98.0, 1, 49.5)


def test_skewness_verdicts(spark, frame):
    assert stats.skewness(frame(series(9, fn=lambda i: i**3)), "value").first().verdict == "right"
    assert stats.skewness(frame(series(9, fn=lambda i: -(i**3))), "value").first().verdict == "left"
    assert stats.skewness(frame(series(3, fn=lambda i: i - 1)), "value").first().verdict == "symmetric"


def ar1(phi, n=1500):
    x = [0.0]
    for e in NOISE[: n - 1]:
        x.append(phi * x[-1] + e)
    return x


def numpy_acf(x, lags):
    x = np.asarray(x) - np.mean(x)
    return [float(x[: len(x) - h] @ x[h:] / (x @ x)) for h in range(lags + 1)]


def test_acf_and_pacf(spark, frame, path):
    x = ar1(0.6, 400)
    df = frame(series(400, fn=lambda i: x[i]))
    got = timestats.acf(df, "value", "ts", 8).orderBy("lag").toPandas()
    assert np.allclose(got.acf, numpy_acf(x, 8))
    partial = timestats.pacf(df, "value", "ts", 8).orderBy("lag").toPandas().pacf
    r = np.asarray(numpy_acf(x, 8))
    for k in range(1, 9):
        toeplitz = r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
        assert np.isclose(partial[k], np.linalg.solve(toeplitz, r[1 : k + 1])[-1])


def test_acf_of_short_and_constant_series(spark, frame):
    assert timestats.acf(frame(series(3)), "value", "ts", 10).count() == 3
    flat = timestats.acf(frame(series(5, fn=lambda i: 2)), "value", "ts", 2).collect()
    assert all(r.acf is None for r in flat)


def slow_adf(x, max_lag=None):
    """The test by explicit regressions, for comparison."""
    x = np.asarray(x, dtype=float)
    d = np.diff(x)
    top = timestats.adf_max_lag(len(x)) if max_lag is None else max_lag

    def fit(p, skip):
        t = np.arange(skip, len(d))
        cols = [x[t], np.ones(len(t))] + [d[t - j] for j in range(1, p + 1)]
        a = np.column_stack(cols)
        beta, *_ = np.linalg.lstsq(a, d[t], rcond=None)
        ssr = float(((d[t] - a @ beta) ** 2).sum())
        return beta, ssr, a, len(t)

    aic = []
    for p in range(top + 1):
        _, ssr, a, n = fit(p, top)
        aic.append(n * math.log(ssr / n) + 2 * (p + 2))
    best = int(np.argmin(aic))
    beta, ssr, a, n = fit(best, best)
    se = math.sqrt(ssr / (n - a.shape[1]) * np.linalg.inv(a.T @ a)[0, 0])
    return beta[0] / se, best, n


@pytest.mark.parametrize("phi, n", [(0.5, 300), (1.0, 300), (0.9, 61), (-0.4, 25)])
def test_adf_equals_explicit_regressions(spark, frame, path, phi, n):
    x = [100 + v for v in ar1(phi, n)]
    got = timestats.adf_test(frame(series(n, fn=lambda i: x[i])), "value", "ts").first()
    stat, lag, rows = slow_adf(x)
    assert (got.used_lag, got.n_obs) == (lag, rows)
    assert np.isclose(got.statistic, stat, rtol=1e-6)


def test_adf_verdicts_per_key(spark, frame, path):
    noise, walk = ar1(0.2, 400), ar1(1.0, 400)
    rows = series(400, fn=lambda i: noise[i], key="noise") + series(200, fn=lambda i: walk[i], key="walk")
    rows += series(30, fn=lambda i: 1, key="flat") + series(2, key="short")
    got = {r.k: r for r in timestats.adf_test(frame(rows, "k string, ts timestamp, value double"), "value", "ts", ["k"]).collect()}
    assert got["noise"].verdict == "Stationary"
    assert np.isclose(got["noise"].statistic, slow_adf(noise)[0], rtol=1e-6)
    assert np.isclose(got["walk"].statistic, slow_adf(walk[:200])[0], rtol=1e-6)
    assert got["flat"].verdict is None and got["short"].verdict is None


def test_adf_p_values_at_critical_points():
    for level, coefs in timestats.ADF_CRITICAL.items():
        assert abs(timestats.adf_p_value(coefs[0]) - float(level[:-1]) / 100) < 5e-4


def test_seasonality_report(spark, frame):
    df = frame(series(200, fn=lambda i: math.sin(2 * math.pi * i / 24) + 0.01 * NOISE[i]))
    got = timestats.seasonality_trend_report(df, "value", "ts").first()
    assert got.seasonal_variance > 50 * got.resid_variance


def test_reports(spark, frame):
    x = ar1(0.5, 120)
    df = frame(series(120, fn=lambda i: x[i])).withColumn("other", F.col("value") * 2)
    got = stats.summary_report(df, "value", "ts", 3, features=["other"]).toPandas()
    assert {"importance", "adf_p_value", "acf", "correlation", "pct_outliers"} <= set(got.metric)
    both = stats.frequency_report({"H": df, "D": df}, "value", "ts", 2)
    assert {r.freq for r in both.select("freq").distinct().collect()} == {"H", "D"}


def test_standard_scale_uses_train_only(spark, frame):
    df = split.chronological_split(frame(series(50, fn=lambda i: i if i < 30 else 1000)), "ts")
    got = scale.standard_scale(df, ["value"]).filter("split = 'train'").toPandas().value
    assert np.isclose(got.mean(), 0) and np.isclose(got.std(ddof=0), 1)
    flat = split.chronological_split(frame(series(10, fn=lambda i: 4)), "ts")
    assert {r.value for r in scale.standard_scale(flat, ["value"]).collect()} == {0.0}
    with pytest.raises(ValueError):
        scale.standard_scale(flat, ["value"], fit_on="other")


def test_minmax_round_trip_and_constant(spark, frame):
    df = frame(series(10, fn=lambda i: 3 * i)).withColumn("flat", F.lit(7.0))
    bounds = scale.minmax_bounds(df, ["value", "flat"])
    scaled = scale.minmax_scale(df, bounds)
    assert {r.flat for r in scaled.collect()} == {0.0}
    back = scale.minmax_inverse(scaled, bounds).orderBy("ts").toPandas()
    assert np.allclose(back.value, 3 * np.arange(10)) and set(back.flat) == {7.0}


def test_components_for_share():
    ratios = [0.52324796, 0.22921710, 0.21111338, 0.03642156]
    assert scale.components_for(ratios, 0.95) == 3
    assert scale.components_for(ratios, 0.999) == 4


def make_scores(spark):
    rows = [(i, float(y), float(p)) for i, (y, p) in enumerate([(1, 2), (3, 3), (6, 4), (2, 2)])]
    return spark.createDataFrame(rows, "t int, actual double, predicted double")


def test_metrics_by_hand(spark, path):
    got = metrics.score(make_scores(spark), "t").first()
    assert np.isclose(got.MAE, 3 / 4) and np.isclose(got.MSE, 5 / 4) and np.isclose(got.RMSE, math.sqrt(5 / 4))
    assert np.isclose(got.MAPE, (1 + 0 + 2 / 6 + 0) / 4) and np.isclose(got.Bias, -1 / 4)
    assert np.isclose(got.MASE, 0.75 / ((2 + 3 + 4) / 3))
    swapped = metrics.error_metrics(make_scores(spark), swap=True).first()
    assert np.isclose(swapped.Bias, 1 / 4)


def test_mase_of_flat_series_is_null(spark):
    df = spark.createDataFrame([(i, 2.0, 1.0) for i in range(4)], "t int, actual double, predicted double")
    assert metrics.mase(df, "t").first().MASE is None


def test_zero_actual_keeps_mape_finite(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0)], "t int, actual double, predicted double")
    assert math.isfinite(metrics.error_metrics(df).first().MAPE)


def test_actual_vs_predicted_checks_both_sides(spark):
    df = make_scores(spark)
    both = metrics.actual_vs_predicted(df.select("t", "actual"), df.select("t", "predicted"), "t", name="test")
    assert both.count() == 4
    with pytest.raises(Exception, match="do not match"):
        metrics.actual_vs_predicted(df.select("t", "actual"), df.filter("t > 0").select("t", "predicted"), "t").collect()


def test_compare_models(spark):
    rows = [("a", "H", "test", 2.0), ("b", "H", "test", 1.0), ("c", "H", "test", None)]
    got = {r.model: r["rank"] for r in metrics.compare_models(spark.createDataFrame(rows, "model string, freq string, split string, MAE double")).collect()}
    assert got == {"b": 1, "a": 2, "c": 3}


def test_block_products_of_many_series_at_once():
    """Sums over the blocks of a batch equal those of each whole series, whatever its length."""
    import pyarrow as pa

    r, size, limit, rows = np.random.default_rng(0), 7, 3, []
    many = [r.normal(size=n) for n in (1, 2, 7, 8, 20, 30)]
    for s, x in enumerate(many):
        for b in range(-(-len(x) // size)):
            rows += [(s, t, len(x), x[t], b) for t in range(max(0, b * size - 1), min(len(x), (b + 1) * size + limit))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["k", "__t", "__n", "__x", "__b"])
    got = timestats._block_products(batch, ["k"], size, limit).to_pandas()
    for s, x in enumerate(many):
        d, mine = np.diff(x), got[got.k == s]
        want = [x.sum(), x @ x, d @ x[1:], *(d[: len(d) - h] @ d[h:] if h < len(d) else 0.0 for h in range(limit + 1))]
        assert np.allclose(mine[mine.kind == 0].groupby("i").v.sum(), want)
        assert mine[mine.kind == 3].v.tolist() == [len(x)]
        assert sorted(mine[mine.kind == 1].i) == list(range(min(len(x), limit + 2)))
        assert sorted(mine[mine.kind == 2].i) == list(range(max(0, len(x) - limit - 2), len(x)))
