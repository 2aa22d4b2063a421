"""Registered queries: forecasters, tuning, saved models.

Models take the registry's parameters, searches their full number of candidates, folds
and epochs. Hundreds of sequential rounds take Spark minutes a model; README.md has the
seconds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tuning
from ..models.arx import arx_forecast, order_grid_search
from ..models.base import load_model, save_model
from ..models.network import window_forecast
from ..models.panel import arx_forecast_ar1_per_key, linear_forecast_per_key
from ..models.ranking import rank_models
from ..models.tabular import feature_importance, train_and_evaluate
from ..models.vote import voting_forecast
from ..operators.clean import impute_missing
from ..operators.metrics import compare_models
from ..operators.ordered import profile
from ..operators.resample import resample_median
from ..operators.split import chronological_split
from ..operators.stats import residual_report
from ..schema import CHANNELS, FEATURES, TARGET
from ..session import new_path
from . import tables as tb
from .explore import SQL_FILLED_SPLIT, SQL_MASE, SQL_SCORES, SQL_SPLIT, _sql_describe
from .register import query, rounded

QUERY_NAMES = {
    "linear": "linear_forecast",
    "svr": "svr_forecast",
    "gradient_boosting": "gbt_forecast",
    "histogram_gradient_boosting": "hist_gbt_forecast",
    "xgboost": "xgb_forecast",
    "catboost": "cat_forecast",
    "adaboost": "adaboost_forecast",
    "random_forest": "forest_forecast",
    "random_forest_raw": "forest_raw_forecast",
}


def _sql_ols(features=FEATURES) -> str:
    """``ols``: least squares on the train rows by successive orthogonal residuals, predicted for all rows."""
    ctes, before = [], "sp"
    for i, x in enumerate([*features, TARGET]):
        shares = [f"sum({x} * e{j}) FILTER (split = 'train') / sum(e{j} * e{j}) FILTER (split = 'train') AS b{j}" for j in range(i)]
        ctes.append(f"k{i} AS (SELECT {', '.join([f'avg({x}) FILTER (split = {chr(39)}train{chr(39)}) AS a', *shares])} FROM {before})")
        fitted = " + ".join([f"k{i}.a", *[f"k{i}.b{j} * e{j}" for j in range(i)]])
        if x == TARGET:
            ctes.append(f"ols AS (SELECT {before}.*, {fitted} AS predicted, {TARGET} AS actual FROM {before}, k{i})")
        else:
            ctes.append(f"g{i} AS (SELECT {before}.*, {x} - ({fitted}) AS e{i} FROM {before}, k{i})")
            before = f"g{i}"
    return ", ".join(ctes)


SQL_OLS = f"{tb.sql_daily()}, {SQL_FILLED_SPLIT}, {_sql_ols()}"


def _sql_held_scores(source: str, model: str, freq: str = "D") -> str:
    return f"""held AS (SELECT *, lag(actual) OVER (PARTITION BY split ORDER BY epoch) AS prev FROM {source} WHERE split <> 'train')
SELECT '{model}' AS model, '{freq}' AS freq, split, {SQL_SCORES}, {SQL_MASE} FROM held GROUP BY split"""


# First-order autoregression of the residuals, forecast from the end of the train rows.
SQL_AR1 = f"""{SQL_OLS},
eta AS (SELECT epoch, actual - predicted AS v, lag(actual - predicted) OVER (ORDER BY epoch) AS u FROM ols WHERE split = 'train'),
ar AS (SELECT sum(v * u) / sum(u * u) AS phi, sqrt((sum(v * v) FILTER (u IS NOT NULL) - sum(v * u) * sum(v * u) / sum(u * u)) / count(u)) AS sigma,
 max_by(v, epoch) AS last, count(*) AS nt FROM eta),
ar1 AS (SELECT epoch, split, actual, pos - nt + 1 AS h, phi, sigma, predicted AS base, predicted + pow(phi, pos - nt + 1) * last AS predicted
 FROM ols, ar WHERE split <> 'train')"""


def _table(spark, sf_dir):
    return tb.daily_filled(spark, sf_dir)


for _algorithm, _name in QUERY_NAMES.items():

    # All four components are kept here, so the linear model is plain least squares.
    @query(_name, f"WITH {SQL_OLS}, {_sql_held_scores('ols', 'linear')}" if _algorithm == "linear" else None)
    def tabular(spark, sf_dir, algorithm=_algorithm):
        made = train_and_evaluate(_table(spark, sf_dir), algorithm, "D", "start_ts")
        return rounded(made.scores)


@query("svr_forecast_rbf")
def svr_forecast_rbf(spark, sf_dir):
    made = train_and_evaluate(_table(spark, sf_dir), "svr", "H", "start_ts")
    return rounded(made.scores, 4)


@query(
    "linear_forecast_one_feature",
    f"""WITH {tb.sql_daily()}, {SQL_FILLED_SPLIT},
fit AS (SELECT regr_slope(pm25_value, pm10_value) AS b, regr_intercept(pm25_value, pm10_value) AS a FROM sp WHERE split = 'train'),
pr AS (SELECT epoch, split, pm25_value AS actual, a + b * pm10_value AS predicted FROM sp, fit WHERE split <> 'train'),
l AS (SELECT *, lag(actual) OVER (PARTITION BY split ORDER BY epoch) AS prev FROM pr)
SELECT 'linear_raw' AS model, 'D' AS freq, split, {SQL_SCORES}, {SQL_MASE} FROM l GROUP BY split""",
)
def linear_forecast_one_feature(spark, sf_dir):
    made = train_and_evaluate(_table(spark, sf_dir), "linear_raw", "D", "start_ts", features=["pm10_value"])
    return rounded(made.scores)


@query(
    "compare_fitted_models",
    f"""WITH {SQL_OLS},
fit AS (SELECT regr_slope(pm25_value, pm10_value) AS b, regr_intercept(pm25_value, pm10_value) AS a FROM sp WHERE split = 'train'),
pr AS (SELECT epoch, split, pm25_value AS actual, a + b * pm10_value AS predicted FROM sp, fit),
u AS (SELECT 'linear' AS model, epoch, split, actual, predicted FROM ols UNION ALL SELECT 'linear_raw', epoch, split, actual, predicted FROM pr),
held AS (SELECT *, lag(actual) OVER (PARTITION BY model, split ORDER BY epoch) AS prev FROM u WHERE split <> 'train'),
sc AS (SELECT model, 'D' AS freq, split, {SQL_SCORES}, {SQL_MASE} FROM held GROUP BY model, split)
SELECT *, row_number() OVER (PARTITION BY freq, split ORDER BY "MAE", model) AS rank FROM sc""",
)
def compare_fitted_models(spark, sf_dir):
    """Two fitted models ranked within the frequency."""
    table = _table(spark, sf_dir)
    full = train_and_evaluate(table, "linear", "D", "start_ts").scores
    narrow = train_and_evaluate(table, "linear_raw", "D", "start_ts", features=["pm10_value"]).scores
    return rounded(compare_models(full.unionByName(narrow)))


@query(
    "residual_report_arx",
    f"WITH {SQL_AR1}, e AS (SELECT actual - predicted AS residual FROM ar1) " + _sql_describe("e", ["residual"]),
)
def residual_report_arx(spark, sf_dir):
    made = arx_forecast(_table(spark, sf_dir), "D", "start_ts", order=(1, 0, 0))
    return rounded(residual_report(made.predictions))


@query("arx_forecast")
def arx(spark, sf_dir):
    return rounded(arx_forecast(_table(spark, sf_dir), "D", "start_ts").scores)


@query("arx_forecast_regression", f"WITH {SQL_OLS}, {_sql_held_scores('ols', 'sarimax', 'H')}")
def arx_regression(spark, sf_dir):
    return rounded(arx_forecast(_table(spark, sf_dir), "H", "start_ts").scores)


@query("arx_forecast_ar1", f"WITH {SQL_AR1}, {_sql_held_scores('ar1', 'sarimax')}")
def arx_ar1(spark, sf_dir):
    return rounded(arx_forecast(_table(spark, sf_dir), "D", "start_ts", order=(1, 0, 0)).scores)


@query(
    "forecast_interval",
    f"""WITH {SQL_AR1}, w AS (SELECT *, 1.959963984540054::DOUBLE * sigma * sqrt((1 - pow(phi, 2 * h)) / (1 - phi * phi)) AS half FROM ar1)
SELECT epoch, actual, round(predicted, 6) AS prediction, round(predicted - half, 6) AS lower, round(predicted + half, 6) AS upper, split
FROM (SELECT * REPLACE (round(actual, 6) AS actual) FROM w)""",
)
def forecast_interval(spark, sf_dir):
    table = _table(spark, sf_dir)
    model = arx_forecast(table, "D", "start_ts", order=(1, 0, 0)).model
    rows = model.interval(chronological_split(table, "start_ts"))
    return rounded(rows.select(tb.epoch(), F.col(TARGET).alias("actual"), "prediction", "lower", "upper", "split"))


@query("forecast_interval_registry")
def forecast_interval_registry(spark, sf_dir):
    table = _table(spark, sf_dir)
    model = arx_forecast(table, "W", "start_ts").model
    rows = model.interval(chronological_split(table, "start_ts"))
    return rounded(rows.select(tb.epoch(), F.col(TARGET).alias("actual"), "prediction", "lower", "upper", "split"))


def frequency_tables(spark, sf_dir) -> dict:
    """Complete tables at H, D, W and M: hours of the events, days of the orders and their medians."""
    days = tb.daily(spark, sf_dir)
    made = {"H": tb.hourly_clean(spark, sf_dir), "D": days, **{f: resample_median(days, "start_ts", f, CHANNELS) for f in "WM"}}
    return {f: impute_missing(df, CHANNELS) for f, df in made.items()}


for _freq in "HDWM":

    # Ranks are within the frequency, so each one is a query of its own.
    @query(f"rank_models_{_freq.lower()}")
    def rank_all(spark, sf_dir, freq=_freq):
        """Every model with its registry parameters, ranked at one frequency."""
        return rounded(rank_models({freq: frequency_tables(spark, sf_dir)[freq]}, "start_ts"), 2)


# One series per supplier: prices of its lines, in thousands, in the order of their numbers (the largest of equal ones).
PANEL_FEATURES = ("quantity", "discount", "tax")


def _panel(spark, sf_dir):
    """The panel, and the profile of its lines before equal numbers fall together, which costs no shuffle of them."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    number = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).cast("bigint").alias("num")
    prof = profile(lines.select(F.col("l_suppkey").alias("station"), number), "num", ["station"])
    values = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax", "price": "l_extendedprice"}
    cells = [(F.max(c).cast("double") / (1000.0 if n == "price" else 1.0)).alias(n) for n, c in values.items()]
    return lines.groupBy(F.col("l_suppkey").alias("station"), number).agg(*cells), prof


def _sql_panel() -> str:
    """``ols``: least squares of every station by successive orthogonal residuals of its train rows."""
    ctes, before = [], "e0x"
    for i, x in enumerate([*PANEL_FEATURES, "price"]):
        shares = [f"coalesce(sum({x} * e{j}) FILTER (split = 'train') / nullif(sum(e{j} * e{j}) FILTER (split = 'train'), 0), 0) AS b{j}" for j in range(i)]
        ctes.append(f"m{i} AS (SELECT station, {', '.join([f'avg({x}) FILTER (split = {chr(39)}train{chr(39)}) AS a', *shares])} FROM {before} GROUP BY station)")
        fitted = " + ".join(["a", *[f"b{j} * e{j}" for j in range(i)]])
        name, made = ("ols", f"{fitted} AS predicted, price AS actual") if x == "price" else (f"e{i}y", f"{x} - ({fitted}) AS e{i}")
        ctes.append(f"{name} AS (SELECT b.*, {made} FROM {before} b JOIN m{i} USING (station))")
        before = name
    return f"""l AS (SELECT l_suppkey AS station, CAST((l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey AS BIGINT) AS num, CAST(max(l_quantity) AS DOUBLE) AS quantity,
 CAST(max(l_discount) AS DOUBLE) AS discount, CAST(max(l_tax) AS DOUBLE) AS tax, CAST(max(l_extendedprice) AS DOUBLE) / CAST(1000 AS DOUBLE) AS price
 FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY num) - 1 AS pos, count(*) OVER (PARTITION BY station) AS n FROM l),
e0x AS (SELECT *, {SQL_SPLIT} AS split FROM c), {', '.join(ctes)}"""


def _sql_panel_scores(source: str, model: str) -> str:
    return f"""held AS (SELECT *, lag(actual) OVER (PARTITION BY station, split ORDER BY num) AS prev FROM {source} WHERE split <> 'train')
SELECT station, '{model}' AS model, 'D' AS freq, split, {SQL_SCORES}, {SQL_MASE} FROM held GROUP BY station, split"""


@query("linear_forecast_per_key", f"WITH {_sql_panel()}, {_sql_panel_scores('ols', 'linear')}")
def linear_per_key(spark, sf_dir):
    panel, prof = _panel(spark, sf_dir)
    return rounded(linear_forecast_per_key(panel, "D", "num", ["station"], PANEL_FEATURES, "price", prof))


@query(
    "arx_forecast_ar1_per_key",
    f"""WITH {_sql_panel()},
eta AS (SELECT station, pos, actual - predicted AS v, lag(actual - predicted) OVER (PARTITION BY station ORDER BY num) AS u FROM ols WHERE split = 'train'),
ar AS (SELECT station, coalesce(sum(v * u) / sum(u * u), 0) AS phi, max_by(v, pos) AS last, max(pos) AS fin FROM eta GROUP BY station),
ar1 AS (SELECT o.station, num, split, actual, predicted + pow(phi, pos - fin) * last AS predicted FROM ols o JOIN ar USING (station)),
{_sql_panel_scores('ar1', 'sarimax')}""",
)
def ar1_per_key(spark, sf_dir):
    panel, prof = _panel(spark, sf_dir)
    return rounded(arx_forecast_ar1_per_key(panel, "D", "num", ["station"], PANEL_FEATURES, "price", prof))


@query("voting_forecast")
def voting(spark, sf_dir):
    return rounded(voting_forecast(_table(spark, sf_dir), "D", "start_ts").scores, 4)


@query("feature_importance")
def importance(spark, sf_dir):
    return rounded(feature_importance(_table(spark, sf_dir), "start_ts"))


for _kind in ("dnn", "cnn", "lstm"):

    @query(f"{_kind}_window_forecast")
    def network(spark, sf_dir, kind=_kind):
        made = window_forecast(_table(spark, sf_dir), kind, "D", "start_ts")
        return rounded(made.scores, 2)


@query(
    "save_model",
    f"WITH {SQL_OLS} SELECT epoch, round(predicted, 6) AS before, round(predicted, 6) AS after FROM ols",
)
def save_and_load(spark, sf_dir):
    table = _table(spark, sf_dir)
    made = train_and_evaluate(table, "linear", "D", "start_ts")
    path = new_path(spark, "model")
    save_model(spark, made.model, path)
    before = made.model.transform(table).select("start_ts", F.col("prediction").alias("before"))
    both = load_model(spark, path).transform(table).join(before, "start_ts")
    return rounded(both.select(tb.epoch(), "before", F.col("prediction").alias("after")))


@query("random_search")
def random_search(spark, sf_dir):
    table, _ = tuning.random_search(_table(spark, sf_dir), "gradient_boosting", "D", "start_ts")
    return rounded(table, 4)


@query("random_search_svr")
def random_search_svr(spark, sf_dir):
    table, _ = tuning.random_search(_table(spark, sf_dir), "svr", "D", "start_ts")
    return rounded(table, 3)


@query(
    "random_search_linear",
    f"""WITH {tb.sql_daily()}, {SQL_FILLED_SPLIT},
tr AS (SELECT pm25_value AS y, pm10_value AS x, pos, count(*) OVER () AS nt, unnest(range(5)) AS fold FROM sp WHERE split = 'train'),
ro AS (SELECT *, nt - (5 - fold) * (nt // 6) AS cut, nt // 6 AS size FROM tr),
ft AS (SELECT fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM ro WHERE pos < cut GROUP BY 1),
ms AS (SELECT fold, avg(pow(a + b * x - y, 2)) AS mse FROM ro JOIN ft USING (fold) WHERE pos >= cut AND pos < cut + size GROUP BY 1)
SELECT 0 AS candidate, round(avg(mse), 6) AS mse, TRUE AS best FROM ms""",
)
def random_search_linear(spark, sf_dir):
    table, _ = tuning.random_search(
        _table(spark, sf_dir), "linear_raw", "D", "start_ts", features=["pm10_value"], candidates=[{}]
    )
    return rounded(table.select("candidate", "mse", "best"))


@query(
    "order_grid_search_ar1",
    f"""WITH {SQL_AR1}
SELECT 0 AS p, 0 AS d, 0 AS q, round(avg(abs(actual - base)), 6) AS "MAE" FROM ar1 WHERE split = 'validation'
UNION ALL SELECT 1, 0, 0, round(avg(abs(actual - predicted)), 6) FROM ar1 WHERE split = 'validation'""",
)
def grid_ar1(spark, sf_dir):
    return rounded(order_grid_search(_table(spark, sf_dir), "start_ts", 1, 0, 0))


@query("order_grid_search")
def grid(spark, sf_dir):
    return rounded(order_grid_search(_table(spark, sf_dir), "start_ts"))


@query("nn_search")
def nn(spark, sf_dir):
    return rounded(tuning.nn_search(_table(spark, sf_dir), "dnn", "D", "start_ts"), 3)
