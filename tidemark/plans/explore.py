"""Registered queries: statistics, ordered views, time-series statistics, scaling, scores."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.naive import naive_forecast, naive_predictions
from ..operators import metrics, scale, sequence, split, stats, timestats
from ..operators.resample import resample_median
from ..schema import CHANNELS, FEATURES, TARGET
from . import tables as tb
from .register import query, rounded

ITEM_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _items(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*ITEM_COLUMNS)


def _hourly_values(spark, sf_dir) -> DataFrame:
    """Highest event value per user and hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start_ts")
    return events.groupBy("user_id", hour).agg(F.max("value").alias("value"))


SQL_USER_HOURS = """h AS (SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS epoch, max(value) AS value
 FROM events GROUP BY 1, 2)"""

def _sql_acf(source: str, max_lag: int, by: str = "") -> str:
    """``source`` yields ``by, epoch, v``."""
    lead, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    same = f"AND a.{by} = b.{by}" if by else ""
    group = f"a.{by}, " if by else ""
    return f"""c AS (SELECT {lead}row_number() OVER ({part}ORDER BY epoch) AS t, count(*) OVER ({part}) AS n,
 v - avg(v) OVER ({part}) AS x FROM ({source})),
l AS (SELECT unnest(range({max_lag + 1})) AS lag),
s AS (SELECT {group}lag, any_value(a.n) AS n, sum(a.x * b.x) AS s FROM c a, l, c b WHERE b.t = a.t + l.lag {same} GROUP BY {group}lag),
r AS (SELECT {lead}lag, n, s / first_value(s) OVER ({part}ORDER BY lag) AS acf FROM s)"""


# ------------------------------------------------------------ statistics


def _sql_describe(source: str, columns) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
 round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
 round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM {source}"""
        for c in columns
    ]
    return " UNION ALL ".join(parts)


@query("describe", _sql_describe("lineitem", ITEM_COLUMNS))
def describe(spark, sf_dir):
    return rounded(stats.describe(_items(spark, sf_dir)))


@query("describe_wide", f"WITH {tb.sql_hourly()} " + _sql_describe("clean", CHANNELS))
def describe_wide(spark, sf_dir):
    return rounded(stats.describe(tb.hourly_clean(spark, sf_dir), CHANNELS))


@query(
    "skewness",
    f"""WITH {tb.sql_readings()},
m AS (SELECT pollutant, avg(value) AS mean, var_pop(value) AS v FROM readings GROUP BY 1),
s AS (SELECT pollutant, avg(pow(value - mean, 3)) / pow(any_value(v), 1.5) AS skewness FROM readings JOIN m USING (pollutant) GROUP BY 1)
SELECT pollutant, round(skewness, 6) AS skewness,
 CASE WHEN skewness > 0 THEN 'right' WHEN skewness < 0 THEN 'left' ELSE 'symmetric' END AS verdict FROM s""",
)
def skewness(spark, sf_dir):
    return rounded(stats.skewness(tb.readings(spark, sf_dir), "value", ["pollutant"]))


@query(
    "correlation_matrix",
    f"WITH {tb.sql_hourly()} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r FROM clean" for a in CHANNELS for b in CHANNELS
    ),
)
def correlation_matrix(spark, sf_dir):
    return rounded(stats.correlation_matrix(tb.hourly_clean(spark, sf_dir), CHANNELS))


def _sql_bin(value: str, bins: int = 15) -> str:
    return f"least(CAST(floor(({value} - lo) * {bins} / CASE WHEN hi > lo THEN hi - lo ELSE 1.0::DOUBLE END) AS BIGINT), {bins - 1})"


@query(
    "histogram",
    "WITH long AS ("
    + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS value FROM lineitem""" for c in ITEM_COLUMNS)
    + f"""), b AS (SELECT "column", min(value) AS lo, max(value) AS hi FROM long GROUP BY 1),
c AS (SELECT "column", {_sql_bin('value')} AS bin, count(*) AS n FROM long JOIN b USING ("column") GROUP BY 1, 2),
g AS (SELECT "column", lo, hi, unnest(range(15)) AS bin FROM b)
SELECT "column", bin, round(lo + bin * ((hi - lo) / 15), 6) AS bin_start, round(lo + (bin + 1) * ((hi - lo) / 15), 6) AS bin_end,
 coalesce(n, 0) AS count FROM g LEFT JOIN c USING ("column", bin)""",
)
def histogram(spark, sf_dir):
    return rounded(stats.histogram(_items(spark, sf_dir)))


@query(
    "kde",
    """WITH s AS (SELECT count(value) AS n, pow(count(value), -0.2) * stddev_samp(value) AS bw, min(value) AS lo, max(value) AS hi FROM events),
g AS (SELECT n, bw, unnest(range(200)) AS point, lo - 3 * bw AS x0, (hi - lo + 6 * bw) / 199 AS dx FROM s)
SELECT point, round(x0 + point * dx, 6) AS x,
 round(1000 * sum(exp(-0.5 * pow((x0 + point * dx - value) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) AS density_milli
FROM g, events GROUP BY point, x0, dx, n, bw""",
)
def kde(spark, sf_dir):
    made = stats.kde(spark.read.parquet(f"{sf_dir}/events.parquet"), "value")
    return rounded(made.select("point", "x", (1000 * F.col("density")).alias("density_milli")))


@query(
    "box_stats",
    f"""WITH {tb.sql_readings()},
q AS (SELECT pollutant, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
 FROM readings GROUP BY 1),
b AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS lower, q3 + 1.5::DOUBLE * (q3 - q1) AS upper FROM q)
SELECT pollutant, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
 min(value) FILTER (value BETWEEN lower AND upper) AS whisker_low, max(value) FILTER (value BETWEEN lower AND upper) AS whisker_high,
 count(*) FILTER (value NOT BETWEEN lower AND upper) AS n_fliers
FROM readings JOIN b USING (pollutant) GROUP BY pollutant, q1, median, q3""",
)
def box_stats(spark, sf_dir):
    return rounded(stats.box_stats(tb.readings(spark, sf_dir), "value", ["pollutant"]))


def _sql_pairs(columns) -> str:
    ends = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in columns)
    bins = ", ".join(_sql_bin(c).replace("lo)", f"lo_{c})").replace("hi > lo", f"hi_{c} > lo_{c}").replace("hi - lo ", f"hi_{c} - lo_{c} ") + f" AS b_{c}" for c in columns)
    parts = " UNION ALL ".join(
        f"SELECT '{a}' AS col_x, '{b}' AS col_y, b_{a} AS bin_x, b_{b} AS bin_y, count(*) AS count FROM b GROUP BY 3, 4"
        for a, b in combinations(columns, 2)
    )
    return f"WITH e AS (SELECT {ends} FROM lineitem), b AS (SELECT {bins} FROM lineitem, e) {parts}"


@query("pair_bins", _sql_pairs(ITEM_COLUMNS))
def pair_bins(spark, sf_dir):
    return stats.pair_bins(_items(spark, sf_dir))


def _sql_report(source: str = tb.sql_daily()) -> str:
    parts = []
    moments = {
        "count": "CAST(count({c}) AS DOUBLE)", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})",
        "p25": "quantile_cont({c}, 0.25)", "p50": "quantile_cont({c}, 0.5)", "p75": "quantile_cont({c}, 0.75)", "max": "max({c})",
    }
    for c in CHANNELS:
        for m, sql in moments.items():
            parts.append(f"SELECT '{m}' AS metric, '{c}' AS item, {sql.format(c=c)} AS value FROM daily")
        for other in CHANNELS:
            parts.append(f"SELECT 'correlation', '{c}~{other}', corr({c}, {other}) FROM daily")
    parts.append(
        f"""SELECT 'skewness', '{TARGET}', avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5)
 FROM (SELECT value, avg(value) OVER () AS m FROM series)"""
    )
    out = "count(*) FILTER (pm25_value < q1 - 1.5::DOUBLE * (q3 - q1) OR pm25_value > q3 + 1.5::DOUBLE * (q3 - q1))"
    bounds = "(SELECT quantile_cont(pm25_value, 0.25) AS q1, quantile_cont(pm25_value, 0.75) AS q3 FROM daily) AS q"
    parts.append(f"SELECT 'n_outliers', '{TARGET}', CAST({out} AS DOUBLE) FROM daily, {bounds}")
    parts.append(f"SELECT 'pct_outliers', '{TARGET}', 100::DOUBLE * {out} / count(*) FROM daily, {bounds}")
    parts.append("SELECT 'acf', CAST(lag AS VARCHAR), acf FROM r")
    acf = _sql_acf("SELECT epoch, value AS v FROM series", 10)
    return f"WITH {source}, {acf} SELECT metric, item, round(value, 6) AS value FROM ({' UNION ALL '.join(parts)})"


@query("summary_report", _sql_report())
def summary_report(spark, sf_dir):
    # The test statistic of the report has no SQL twin; see ``summary_report_test``.
    report = stats.summary_report(tb.daily(spark, sf_dir), TARGET, "start_ts")
    return rounded(report.filter(F.col("metric") != "adf_p_value"))


# The hourly table in the names of the daily one.
SQL_HOURLY_AS_DAILY = f"""{tb.sql_hourly()}, daily AS (SELECT * FROM clean),
series AS (SELECT start_ts, epoch, pm25_value AS value FROM clean WHERE pm25_value IS NOT NULL)"""


@query("summary_report_hourly", _sql_report(SQL_HOURLY_AS_DAILY))
def summary_report_hourly(spark, sf_dir):
    """The hourly part of ``frequency_report``, without the test statistic."""
    report = stats.summary_report(tb.hourly_clean(spark, sf_dir), TARGET, "start_ts")
    return rounded(report.filter(F.col("metric") != "adf_p_value"))


@query("summary_report_test")
def summary_report_test(spark, sf_dir):
    """The row of the report that ``summary_report`` leaves to this query."""
    report = stats.summary_report(tb.daily(spark, sf_dir), TARGET, "start_ts")
    return rounded(report.filter(F.col("metric") == "adf_p_value"))


@query("frequency_report")
def frequency_report(spark, sf_dir):
    """The report of the hourly table, the daily one and its weekly and monthly medians."""
    daily = tb.daily(spark, sf_dir)
    tables = {"H": tb.hourly_clean(spark, sf_dir), "D": daily, **{f: resample_median(daily, "start_ts", f, CHANNELS).drop("start_ts_Timestamp") for f in ("W", "M")}}
    return rounded(stats.frequency_report(tables, TARGET, "start_ts"))


# ------------------------------------------------------------ ordered views


@query(
    "rolling_mean_std",
    f"""WITH {tb.sql_daily()}
SELECT epoch, CASE WHEN count(value) OVER w = 12 THEN round(avg(value) OVER w, 6) END AS rolling_mean,
 CASE WHEN count(value) OVER w = 12 THEN round(stddev_samp(value) OVER w, 6) END AS rolling_std
FROM series WINDOW w AS (ORDER BY epoch ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
)
def rolling_mean_std(spark, sf_dir):
    made = sequence.rolling_mean_std(tb.target_series(spark, sf_dir), "value", "start_ts")
    return rounded(made.select(tb.epoch(), "rolling_mean", "rolling_std"))


@query(
    "rolling_mean_std_per_key",
    f"""WITH {SQL_USER_HOURS}
SELECT user_id, epoch, CASE WHEN count(value) OVER w = 12 THEN round(avg(value) OVER w, 6) END AS rolling_mean,
 CASE WHEN count(value) OVER w = 12 THEN round(stddev_samp(value) OVER w, 6) END AS rolling_std
FROM h WINDOW w AS (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
)
def rolling_mean_std_per_key(spark, sf_dir):
    made = sequence.rolling_mean_std(_hourly_values(spark, sf_dir), "value", "start_ts", keys=["user_id"])
    return rounded(made.select("user_id", tb.epoch(), "rolling_mean", "rolling_std"))


@query(
    "lag",
    f"""WITH {tb.sql_daily()}, f AS (SELECT epoch, lag(value) OVER (ORDER BY epoch) AS forecast, lag(value, 7) OVER (ORDER BY epoch) AS week_ago FROM series)
SELECT epoch, forecast, week_ago FROM f""",
)
def lag(spark, sf_dir):
    one = sequence.lag(tb.target_series(spark, sf_dir), "value", "start_ts", name="forecast")
    return sequence.lag(one, "value", "start_ts", 7, name="week_ago").select(tb.epoch(), "forecast", "week_ago")


@query(
    "lag_per_key",
    f"WITH {SQL_USER_HOURS} SELECT user_id, epoch, lag(value) OVER (PARTITION BY user_id ORDER BY epoch) AS forecast FROM h",
)
def lag_per_key(spark, sf_dir):
    made = sequence.lag(_hourly_values(spark, sf_dir), "value", "start_ts", keys=["user_id"], name="forecast")
    return made.select("user_id", tb.epoch(), "forecast")


@query(
    "difference",
    f"""WITH {tb.sql_daily()}, d AS (SELECT epoch, value - lag(value, 1) OVER (ORDER BY epoch) AS d1, value - lag(value, 2) OVER (ORDER BY epoch) AS d2 FROM series)
SELECT epoch, 1 AS "order", round(d1, 6) AS diff FROM d WHERE d1 IS NOT NULL
UNION ALL SELECT epoch, 2, round(d2, 6) FROM d WHERE d2 IS NOT NULL""",
)
def difference(spark, sf_dir):
    made = sequence.difference(tb.target_series(spark, sf_dir), "value", "start_ts")
    return rounded(made.select(tb.epoch(), "order", "diff"))


@query(
    "difference_iterated",
    f"""WITH {tb.sql_daily()}, d AS (SELECT epoch, value - lag(value) OVER (ORDER BY epoch) AS d1 FROM series),
e AS (SELECT epoch, d1, d1 - lag(d1) OVER (ORDER BY epoch) AS d2 FROM d)
SELECT epoch, 1 AS "order", round(d1, 6) AS diff FROM e WHERE d1 IS NOT NULL
UNION ALL SELECT epoch, 2, round(d2, 6) FROM e WHERE d2 IS NOT NULL""",
)
def difference_iterated(spark, sf_dir):
    made = sequence.difference(tb.target_series(spark, sf_dir), "value", "start_ts", mode="order")
    return rounded(made.select(tb.epoch(), "order", "diff"))


def _sql_decompose(period: int, tables: str = "", series: str = "series") -> str:
    half = period // 2
    if period % 2 == 0:
        trend = f"""(sum(value) OVER (ORDER BY t ROWS BETWEEN {half} PRECEDING AND {half - 1} FOLLOWING)
 + sum(value) OVER (ORDER BY t ROWS BETWEEN {half - 1} PRECEDING AND {half} FOLLOWING)) / {2 * period}::DOUBLE"""
    else:
        trend = f"avg(value) OVER (ORDER BY t ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    return f"""WITH {tables or tb.sql_daily()}, p AS (SELECT epoch, value, row_number() OVER (ORDER BY epoch) - 1 AS t, count(*) OVER () AS n FROM {series}),
tr AS (SELECT *, CASE WHEN t >= {half} AND t < n - {half} THEN {trend} END AS trend FROM p),
m AS (SELECT t % {period} AS slot, avg(value - trend) AS m FROM tr GROUP BY 1),
ix AS (SELECT slot, m - avg(m) OVER () AS seasonal FROM m)
SELECT epoch, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(value - trend - seasonal, 6) AS resid
FROM tr JOIN ix ON tr.t % {period} = ix.slot"""


for _period in (24, 7):

    @query(f"seasonal_decompose_{_period}", _sql_decompose(_period))
    def seasonal_decompose(spark, sf_dir, period=_period):
        made = sequence.seasonal_decompose(tb.target_series(spark, sf_dir), "value", "start_ts", period)
        return rounded(made.select(tb.epoch(), "trend", "seasonal", "resid"))


def _sql_windows(table: str, a: str, b: str, w: int = 24) -> str:
    return f"""SELECT pos, y_epoch, x_first, x_last, x_sum, y_first, y_last FROM (
SELECT row_number() OVER o - 1 AS pos, count(*) OVER () AS n, lead(epoch, {w}) OVER o AS y_epoch,
 round({a}, 6) AS x_first, round(lead({b}, {w - 1}) OVER o, 6) AS x_last,
 round(sum({a} + {b}) OVER (ORDER BY epoch ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING), 6) AS x_sum,
 round(lead({a}, {w}) OVER o, 6) AS y_first, round(lead({b}, {w}) OVER o, 6) AS y_last
FROM {table} WINDOW o AS (ORDER BY epoch)) WHERE pos <= n - {w} - 2"""


@query("create_windows", f"WITH {tb.sql_daily()} " + _sql_windows("filled", "pm25_value", "no2_value"))
def create_windows(spark, sf_dir):
    made = sequence.create_windows(tb.daily_filled(spark, sf_dir), ["pm25_value", "no2_value"], "start_ts")
    total = F.aggregate(F.flatten("x"), F.lit(0.0), lambda s, v: s + v)
    return rounded(
        made.select(
            "pos",
            tb.epoch("y_time", "y_epoch"),
            F.col("x")[0][0].alias("x_first"),
            F.col("x")[23][1].alias("x_last"),
            total.alias("x_sum"),
            F.col("y")[0].alias("y_first"),
            F.col("y")[1].alias("y_last"),
        )
    )


SQL_SPLIT = """CASE WHEN pos < floor(n * 0.6::DOUBLE) THEN 'train'
 WHEN pos < floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'validation' ELSE 'test' END"""


@query(
    "chronological_split",
    f"""WITH {tb.sql_daily()}, p AS (SELECT epoch, row_number() OVER (ORDER BY epoch) - 1 AS pos, count(*) OVER () AS n FROM daily)
SELECT epoch, pos, {SQL_SPLIT} AS split FROM p""",
)
def chronological_split(spark, sf_dir):
    return split.chronological_split(tb.daily(spark, sf_dir), "start_ts").select(tb.epoch(), "pos", "split")


@query(
    "chronological_split_per_key",
    f"""WITH {SQL_USER_HOURS},
p AS (SELECT user_id, epoch, row_number() OVER (PARTITION BY user_id ORDER BY epoch) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM h)
SELECT user_id, epoch, pos, {SQL_SPLIT} AS split FROM p""",
)
def chronological_split_per_key(spark, sf_dir):
    made = split.chronological_split(_hourly_values(spark, sf_dir), "start_ts", keys=["user_id"])
    return made.select("user_id", tb.epoch(), "pos", "split")


@query(
    "time_series_folds",
    f"""WITH {tb.sql_daily()}, p AS (SELECT row_number() OVER (ORDER BY epoch) - 1 AS pos, count(*) OVER () AS n FROM daily),
f AS (SELECT pos, n, CAST(unnest(range(5)) AS INTEGER) AS fold FROM p),
r AS (SELECT pos, fold, CASE WHEN pos < n - (5 - fold) * (n // 6) THEN 'train'
 WHEN pos < n - (5 - fold) * (n // 6) + n // 6 THEN 'test' END AS role FROM f)
SELECT fold, role, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM r WHERE role IS NOT NULL GROUP BY 1, 2""",
)
def time_series_folds(spark, sf_dir):
    rows = split.time_series_folds(tb.daily(spark, sf_dir), "start_ts")
    return rows.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )


# ------------------------------------------------------------ time-series statistics


@query(
    "acf",
    f"""WITH {tb.sql_daily()}, {_sql_acf('SELECT epoch, value AS v FROM series', 24)}
SELECT lag, round(acf, 6) AS acf, round(1.959963984540054::DOUBLE / sqrt(n), 6) AS band95, round(2.5758293035489004::DOUBLE / sqrt(n), 6) AS band99 FROM r""",
)
def acf(spark, sf_dir):
    return rounded(timestats.acf(tb.target_series(spark, sf_dir), "value", "start_ts", 24))


@query(
    "acf_of_differences",
    f"""WITH {tb.sql_daily()}, d AS (SELECT epoch, 1 AS "order", value - lag(value, 1) OVER (ORDER BY epoch) AS v FROM series
 UNION ALL SELECT epoch, 2, value - lag(value, 2) OVER (ORDER BY epoch) FROM series),
{_sql_acf('SELECT "order" AS ord, epoch, v FROM d WHERE v IS NOT NULL', 10, 'ord')}
SELECT ord AS "order", lag, round(acf, 6) AS acf FROM r""",
)
def acf_of_differences(spark, sf_dir):
    diffs = sequence.difference(tb.target_series(spark, sf_dir), "value", "start_ts")
    return rounded(timestats.acf(diffs, "diff", "start_ts", 10, ["order"]).select("order", "lag", "acf"))


@query(
    "pacf",
    f"""WITH {tb.sql_daily()}, {_sql_acf('SELECT epoch, value AS v FROM series', 3)},
w AS (SELECT max(acf) FILTER (lag = 1) AS a, max(acf) FILTER (lag = 2) AS b, max(acf) FILTER (lag = 3) AS c FROM r)
SELECT CAST(0 AS BIGINT) AS lag, 1.0::DOUBLE AS pacf UNION ALL SELECT 1, round(a, 6) FROM w
UNION ALL SELECT 2, round((b - a * a) / (1 - a * a), 6) FROM w
UNION ALL SELECT 3, round((c - 2 * a * b + a * a * a + a * b * b - a * a * c) / (1 - 2 * a * a - b * b + 2 * a * a * b), 6) FROM w""",
)
def pacf(spark, sf_dir):
    # Closed forms exist up to lag 3; higher lags are tested against constructed series.
    return rounded(timestats.pacf(tb.target_series(spark, sf_dir), "value", "start_ts", 3))


@query("pacf_40")
def pacf_40(spark, sf_dir):
    return rounded(timestats.pacf(tb.target_series(spark, sf_dir), "value", "start_ts", 40))


@query("adf_test")
def adf_test(spark, sf_dir):
    return rounded(timestats.adf_test(tb.target_series(spark, sf_dir), "value", "start_ts"))


@query(
    "adf_test_no_lags",
    f"""WITH {tb.sql_daily()}, d AS (SELECT value - lag(value) OVER (ORDER BY epoch) AS dy, lag(value) OVER (ORDER BY epoch) AS y FROM series),
m AS (SELECT count(*) AS n, regr_slope(dy, y) AS b, regr_sxx(dy, y) AS sxx, regr_syy(dy, y) AS syy FROM d WHERE y IS NOT NULL)
SELECT CAST(n AS BIGINT) AS n_obs, CAST(0 AS BIGINT) AS used_lag, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 6) AS statistic FROM m""",
)
def adf_test_no_lags(spark, sf_dir):
    made = timestats.adf_test(tb.target_series(spark, sf_dir), "value", "start_ts", max_lag=0)
    return rounded(made.select("n_obs", "used_lag", "statistic"))


# Squared residuals with and without the lagged difference on the common sample, by AIC;
# the statistic of the chosen regression on its own sample.
_SQL_ADF_ONE = """d AS (SELECT epoch, value - lag(value) OVER w AS dy, lag(value) OVER w AS y FROM series WINDOW w AS (ORDER BY epoch)),
r AS (SELECT *, lag(dy) OVER (ORDER BY epoch) AS dl FROM d),
c AS (SELECT *, y - regr_slope(y, dl) OVER () * dl - regr_intercept(y, dl) OVER () AS ey,
 dy - regr_slope(dy, dl) OVER () * dl - regr_intercept(dy, dl) OVER () AS ed FROM r WHERE dl IS NOT NULL),
m AS (SELECT count(*) AS n, sum(ey * ed) / sum(ey * ey) AS b, sum(ey * ey) AS sxx, sum(ed * ed) AS syy,
 regr_syy(dy, y) - pow(regr_slope(dy, y), 2) * regr_sxx(dy, y) AS sse0 FROM c),
o AS (SELECT count(*) AS n, regr_slope(dy, y) AS b, regr_sxx(dy, y) AS sxx, regr_syy(dy, y) AS syy FROM d WHERE y IS NOT NULL),
s AS (SELECT m.n * ln((m.syy - m.b * m.b * m.sxx) / m.n) + 6 < m.n * ln(m.sse0 / m.n) + 4 AS one, m.n AS n1, o.n AS n0,
 m.b / sqrt((m.syy - m.b * m.b * m.sxx) / (m.n - 3) / m.sxx) AS t1, o.b / sqrt((o.syy - o.b * o.b * o.sxx) / (o.n - 2) / o.sxx) AS t0 FROM m, o)"""


@query(
    "adf_test_one_lag",
    f"""WITH {tb.sql_daily()}, {_SQL_ADF_ONE}
SELECT CAST(CASE WHEN one THEN n1 ELSE n0 END AS BIGINT) AS n_obs, CAST(CASE WHEN one THEN 1 ELSE 0 END AS BIGINT) AS used_lag,
 round(CASE WHEN one THEN t1 ELSE t0 END, 6) AS statistic FROM s""",
)
def adf_test_one_lag(spark, sf_dir):
    made = timestats.adf_test(tb.target_series(spark, sf_dir), "value", "start_ts", max_lag=1)
    return rounded(made.select("n_obs", "used_lag", "statistic"))


@query("adf_test_per_key")
def adf_test_per_key(spark, sf_dir):
    return rounded(timestats.adf_test(_hourly_values(spark, sf_dir), "value", "start_ts", ["user_id"]))


@query(
    "seasonality_parts",
    f"""SELECT round(var_pop(trend), 4) AS trend_variance, round(var_pop(seasonal), 4) AS seasonal_variance,
 round(var_pop(resid), 4) AS resid_variance FROM ({_sql_decompose(24, tb.sql_hourly(), "(SELECT epoch, pm25_value AS value FROM clean WHERE pm25_value IS NOT NULL)")})""",
)
def seasonality_parts(spark, sf_dir):
    report = timestats.seasonality_trend_report(tb.hourly_clean(spark, sf_dir), TARGET, "start_ts")
    return rounded(report.select("trend_variance", "seasonal_variance", "resid_variance"), 4)


@query("seasonality_trend_report")
def seasonality_trend_report(spark, sf_dir):
    return rounded(timestats.seasonality_trend_report(tb.hourly_clean(spark, sf_dir), TARGET, "start_ts"))


# ------------------------------------------------------------ scaling

SQL_FILLED_SPLIT = f"""p AS (SELECT *, row_number() OVER (ORDER BY epoch) - 1 AS pos, count(*) OVER () AS n FROM filled),
sp AS (SELECT *, {SQL_SPLIT} AS split FROM p)"""


@query(
    "standard_scale",
    f"""WITH {tb.sql_daily()}, {SQL_FILLED_SPLIT}
SELECT epoch, split, {', '.join(f"round(({c} - avg({c}) FILTER (split = 'train') OVER ()) / stddev_pop({c}) FILTER (split = 'train') OVER (), 6) AS {c}" for c in FEATURES)}
FROM sp""",
)
def standard_scale(spark, sf_dir):
    rows = split.chronological_split(tb.daily_filled(spark, sf_dir), "start_ts")
    return rounded(scale.standard_scale(rows, FEATURES).select(tb.epoch(), "split", *FEATURES))


@query(
    "minmax_scale",
    f"""WITH {tb.sql_daily()}
SELECT epoch, {', '.join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in CHANNELS)} FROM daily""",
)
def minmax_scale(spark, sf_dir):
    rows = tb.daily(spark, sf_dir)
    return rounded(scale.minmax_scale(rows, scale.minmax_bounds(rows, CHANNELS)).select(tb.epoch(), *CHANNELS))


@query("minmax_inverse", f"WITH {tb.sql_daily()} SELECT epoch, {', '.join(f'round({c}, 6) AS {c}' for c in CHANNELS)} FROM daily")
def minmax_inverse(spark, sf_dir):
    rows = tb.daily(spark, sf_dir)
    bounds = scale.minmax_bounds(rows, CHANNELS)
    return rounded(scale.minmax_inverse(scale.minmax_scale(rows, bounds), bounds).select(tb.epoch(), *CHANNELS))


@query("pca_variance")
def pca_variance(spark, sf_dir):
    rows = split.chronological_split(tb.daily_filled(spark, sf_dir), "start_ts")
    return rounded(scale.pca_variance(rows))


_CORR2 = " + ".join(f"pow(corr({a}, {b}), 2)" for a in FEATURES for b in FEATURES)
_CORR3 = " + ".join(f"corr({a}, {b}) * corr({b}, {c}) * corr({c}, {a})" for a in FEATURES for b in FEATURES for c in FEATURES)


@query(
    "pca_moments",
    f"""WITH {tb.sql_daily()}, {SQL_FILLED_SPLIT}
SELECT CAST(4 AS BIGINT) AS components, round(({_CORR2}) / 16, 6) AS sum_squares, round(({_CORR3}) / 64, 6) AS sum_cubes FROM sp WHERE split = 'train'""",
)
def pca_moments(spark, sf_dir):
    # Power sums of the explained shares equal traces of powers of the correlation matrix.
    rows = split.chronological_split(tb.daily_filled(spark, sf_dir), "start_ts")
    ratio = F.col("ratio")
    return rounded(
        scale.pca_variance(rows).agg(
            F.count(ratio).alias("components"),
            F.sum(ratio * ratio).alias("sum_squares"),
            F.sum(ratio * ratio * ratio).alias("sum_cubes"),
        )
    )


_Z = {c: f"({c} - avg({c}) FILTER (split = 'train') OVER ()) / stddev_pop({c}) FILTER (split = 'train') OVER ()" for c in FEATURES}


@query(
    "sarimax_features",
    f"""WITH {tb.sql_daily()}, {SQL_FILLED_SPLIT}
SELECT epoch, pos, split, {', '.join(f'round({c}, 6) AS {c}' for c in CHANNELS)},
 round({' + '.join(f'pow({z}, 2)' for z in _Z.values())}, 6) AS squared_length FROM sp""",
)
def sarimax_features(spark, sf_dir):
    # With every component kept the rotation preserves the length of the scaled features.
    made = scale.sarimax_features(tb.daily_filled(spark, sf_dir), "start_ts", retain=0.9999)
    length = sum((F.col(f"pc{i}") * F.col(f"pc{i}") for i in range(2, 5)), F.col("pc1") * F.col("pc1"))
    return rounded(made.select(tb.epoch(), "pos", "split", *CHANNELS, length.alias("squared_length")))


_SCALED = ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in ("pm25_value", "so2_value"))


@query(
    "window_dataset",
    f"""WITH {tb.sql_daily()}, mm AS (SELECT epoch, {_SCALED} FROM filled),
w AS (SELECT *, count(*) OVER () AS n FROM ({_sql_windows('mm', 'pm25_value', 'so2_value')}))
SELECT pos, y_epoch, x_first, y_first, 9 AS channels, {SQL_SPLIT} AS split FROM w""",
)
def window_dataset(spark, sf_dir):
    made, _ = scale.window_dataset(tb.daily_filled(spark, sf_dir), "start_ts", "D")
    return rounded(
        made.select(
            "pos",
            tb.epoch("y_time", "y_epoch"),
            F.col("x")[0][0].alias("x_first"),
            F.col("y")[0].alias("y_first"),
            F.size("y").alias("channels"),
            "split",
        )
    )


# ------------------------------------------------------------ scores

SQL_NAIVE = f"""nv AS (SELECT epoch, value AS actual, lag(value) OVER (ORDER BY epoch) AS predicted FROM dseries),
np AS (SELECT *, row_number() OVER (ORDER BY epoch) - 1 AS pos, count(*) OVER () AS n FROM nv WHERE actual IS NOT NULL AND predicted IS NOT NULL),
ns AS (SELECT epoch, actual, predicted, pos, {SQL_SPLIT} AS split FROM np),
nl AS (SELECT *, lag(actual) OVER (PARTITION BY split ORDER BY epoch) AS prev FROM ns)"""

# Hourly readings, sentinels null, daily medians with empty days: the flagship input.
SQL_DAILY_MEDIAN = f"""{tb.sql_hourly()},
dm AS (SELECT date_trunc('day', start_ts) AS d, quantile_cont(pm25_value, 0.5) AS value FROM clean GROUP BY 1),
ds AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM dm),
dseries AS (SELECT CAST(epoch(ds.d) AS BIGINT) AS epoch, value FROM ds LEFT JOIN dm ON dm.d = ds.d)"""

SQL_SCORES = """round(avg(abs(actual - predicted)), 6) AS "MAE", round(avg((actual - predicted) * (actual - predicted)), 6) AS "MSE",
 round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS "RMSE",
 round(avg(abs(actual - predicted) / greatest(abs(actual), 2.220446049250313e-16)), 6) AS "MAPE", round(avg(predicted - actual), 6) AS "Bias\""""
SQL_MASE = """round(avg(abs(actual - predicted)) / avg(abs(actual - prev)), 6) AS "MASE\""""


def _daily_medians(spark, sf_dir) -> DataFrame:
    from ..operators.resample import resample_median

    return resample_median(tb.hourly_clean(spark, sf_dir), "start_ts", "D", [TARGET])


@query(
    "naive_forecast",
    f"""WITH {SQL_DAILY_MEDIAN}, {SQL_NAIVE}
SELECT 'naive' AS model, 'D' AS freq, split, {SQL_SCORES}, {SQL_MASE} FROM nl WHERE split <> 'train' GROUP BY split""",
)
def naive_forecast_query(spark, sf_dir):
    return rounded(naive_forecast(_daily_medians(spark, sf_dir), "start_ts", "D"))


SQL_DAILY_NAIVE = f"""{tb.sql_daily()}, dseries AS (SELECT epoch, pm25_value AS value FROM daily), {SQL_NAIVE}"""


def _daily_naive(spark, sf_dir) -> DataFrame:
    return naive_predictions(tb.daily(spark, sf_dir), "start_ts")


@query(
    "naive_predictions",
    f"WITH {SQL_DAILY_NAIVE} SELECT epoch, actual, predicted, pos, split FROM ns",
)
def naive_predictions_query(spark, sf_dir):
    return _daily_naive(spark, sf_dir).select(tb.epoch(), "actual", "predicted", "pos", "split")


@query("error_metrics", f"WITH {SQL_DAILY_NAIVE} SELECT split, {SQL_SCORES} FROM ns GROUP BY split")
def error_metrics(spark, sf_dir):
    return rounded(metrics.error_metrics(_daily_naive(spark, sf_dir), by=["split"]))


@query("mase", f"WITH {SQL_DAILY_NAIVE} SELECT split, {SQL_MASE} FROM nl GROUP BY split")
def mase(spark, sf_dir):
    return rounded(metrics.mase(_daily_naive(spark, sf_dir), "start_ts", by=["split"]))


@query(
    "actual_vs_predicted",
    f"WITH {SQL_DAILY_NAIVE} SELECT epoch, actual, predicted, 'test' AS name FROM ns WHERE split = 'test'",
)
def actual_vs_predicted(spark, sf_dir):
    rows = _daily_naive(spark, sf_dir).filter(F.col("split") == "test")
    joined = metrics.actual_vs_predicted(
        rows.select("start_ts", "actual"), rows.select("start_ts", "predicted"), "start_ts", name="test"
    )
    return joined.select(tb.epoch(), "actual", "predicted", "name")


@query(
    "residual_report",
    f"""WITH {SQL_DAILY_NAIVE}, e AS (SELECT actual - predicted AS residual FROM ns) """ + _sql_describe("e", ["residual"]),
)
def residual_report_query(spark, sf_dir):
    return rounded(stats.residual_report(_daily_naive(spark, sf_dir)))


def _lag_forecasts(spark, sf_dir) -> DataFrame:
    """Three forecasts of the daily target: the value one, two and seven rows ago."""
    series = tb.target_series(spark, sf_dir).withColumnRenamed("value", "actual")
    parts = []
    for back in (1, 2, 7):
        lagged = sequence.lag(series, "actual", "start_ts", back, name="predicted").filter(F.col("predicted").isNotNull())
        named = split.chronological_split(lagged, "start_ts")
        parts.append(named.withColumns({"model": F.lit(f"lag{back}"), "freq": F.lit("D")}))
    return reduce(DataFrame.unionByName, parts)


def _sql_lag_scores() -> str:
    ctes, parts = [], []
    for back in (1, 2, 7):
        ctes.append(
            f"""v{back} AS (SELECT epoch, value AS actual, lag(value, {back}) OVER (ORDER BY epoch) AS predicted FROM series),
n{back} AS (SELECT *, row_number() OVER (ORDER BY epoch) - 1 AS pos, count(*) OVER () AS n FROM v{back} WHERE predicted IS NOT NULL),
s{back} AS (SELECT *, {SQL_SPLIT} AS split FROM n{back}),
l{back} AS (SELECT *, lag(actual) OVER (PARTITION BY split ORDER BY epoch) AS prev FROM s{back})"""
        )
        parts.append(f"SELECT 'lag{back}' AS model, 'D' AS freq, split, {SQL_SCORES}, {SQL_MASE} FROM l{back} WHERE split <> 'train' GROUP BY split")
    return f"""WITH {tb.sql_daily()}, {', '.join(ctes)}, u AS ({' UNION ALL '.join(parts)})
SELECT *, row_number() OVER (PARTITION BY freq, split ORDER BY "MAE", model) AS rank FROM u"""


@query("compare_models", _sql_lag_scores())
def compare_models(spark, sf_dir):
    held = _lag_forecasts(spark, sf_dir).filter(F.col("split") != "train")
    return rounded(metrics.compare_models(metrics.score(held, "start_ts", by=["model", "freq", "split"])))
