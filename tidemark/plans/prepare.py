"""Registered queries: sources, sinks, columns, cleaning, merging, frequencies."""

from __future__ import annotations

import posixpath
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions import time as ft
from ..operators import clean, merge, resample
from ..operators.ordered import place, with_position
from ..schema import CHANNELS, FREQUENCIES, POLLUTANTS, PUBLIC_PREFIX, frequency_schema, to_internal_name
from ..session import new_path
from ..sources import readers, writers
from . import tables as tb
from .register import query, rounded

# ------------------------------------------------------------ sources and sinks


def _write_raw(spark, sf_dir) -> dict[str, str]:
    base = new_path(spark, "raw")
    raw = tb.raw_readings(spark, sf_dir)
    paths = {}
    for name in POLLUTANTS:
        paths[name] = f"{base}/{name}.csv"
        writers.write_table(raw.filter(F.col("Pollutant") == tb.POLLUTANT_CODE[name]), paths[name])
    return paths


@query(
    "read_pollutants",
    f"""WITH {tb.sql_readings()}
SELECT pollutant AS pollutant_name, CAST(code AS BIGINT) AS code, epoch, epoch + 3600 AS end_epoch, value,
       CASE WHEN value = -999 THEN -1 ELSE 1 END AS validity FROM readings""",
)
def read_pollutants(spark, sf_dir):
    stacked = readers.stack_pollutants(readers.read_pollutants(spark, _write_raw(spark, sf_dir)))
    return stacked.select(
        "pollutant_name",
        F.col("Pollutant").cast("bigint").alias("code"),
        tb.epoch("Start"),
        tb.epoch("End", "end_epoch"),
        F.col("Value").alias("value"),
        F.col("Validity").alias("validity"),
    )


def _public_hourly(spark, sf_dir) -> DataFrame:
    """The merged hourly table in public column names, with ``Start, End``."""
    raw = tb.raw_readings(spark, sf_dir)
    wide = merge.merge_by_pivot(
        raw, tb.CODE_POLLUTANT, ["Pollutant", "Value", "Unit", "Validity", "Verification"], by="Pollutant"
    )
    order = [f"{p}_{m}" for p in POLLUTANTS for m in ("Pollutant", "Value", "Unit", "Validity", "Verification")]
    wide = wide.select("Start", "End", *order)
    return wide.withColumnsRenamed({c: f"{PUBLIC_PREFIX[c.split('_')[0]]}-{c.split('_')[1]}" for c in order})


def _write_family(spark, sf_dir) -> str:
    base = new_path(spark, "family")
    built = resample.build_frequencies(clean.sentinel_to_null(_public_hourly(spark, sf_dir)))
    named = {f: df.select(*[f"`{c}`" for c in frequency_schema(f).names]) for f, df in built.items()}
    writers.write_frequencies(named, base)
    return base


def _family_rows(tables_by_freq) -> DataFrame:
    parts = []
    for freq, df in tables_by_freq.items():
        inner = fc.to_internal(df)
        parts.append(
            inner.select(
                F.lit(freq).alias("freq"),
                F.col("Start_Timestamp").alias("epoch"),
                *CHANNELS,
                F.col("pm25_validity").cast("double").alias("pm25_validity"),
                F.col("so2_pollutant").cast("double").alias("so2_pollutant"),
            )
        )
    return rounded(reduce(DataFrame.unionByName, parts))


def _sql_family() -> str:
    cells = ", ".join(
        f"max(CASE WHEN pollutant = '{p}' THEN nullif(value, -999) END) AS {p}_value" for p in POLLUTANTS
    )
    extra = """max(CASE WHEN pollutant = 'pm25' THEN CASE WHEN value = -999 THEN -1 ELSE 1 END END) AS pm25_validity,
 max(CASE WHEN pollutant = 'so2' THEN code END) AS so2_pollutant"""
    value_cols = [f"{p}_value" for p in CHANNELS_SHORT] + ["pm25_validity", "so2_pollutant"]
    medians = ", ".join(f"round(CAST(quantile_cont(CAST({c} AS DOUBLE), 0.5) AS DOUBLE), 6) AS {c}" for c in value_cols)
    plain = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in value_cols)
    parts = [f"SELECT 'H' AS freq, epoch, {plain} FROM wide"]
    labels = {
        "D": ("date_trunc('day', start_ts)", "INTERVAL 1 DAY"),
        "W": ("date_trunc('week', start_ts) + INTERVAL 6 DAY", "INTERVAL 7 DAY"),
        "M": ("last_day(start_ts)", "INTERVAL 1 MONTH"),
    }
    ctes = []
    for f, (label, step) in labels.items():
        ctes.append(f"m{f} AS (SELECT CAST({label} AS TIMESTAMP) AS label, {medians} FROM wide GROUP BY 1)")
        if f == "M":
            spine = "SELECT CAST(last_day(d) AS TIMESTAMP) AS label FROM (SELECT unnest(generate_series(date_trunc('month', min(label)), max(label), INTERVAL 1 MONTH)) AS d FROM mM)"
        else:
            spine = f"SELECT unnest(generate_series(min(label), max(label), {step})) AS label FROM m{f}"
        ctes.append(f"s{f} AS ({spine})")
        cols = ", ".join(value_cols)
        parts.append(f"SELECT '{f}' AS freq, CAST(epoch(label) AS BIGINT) AS epoch, {cols} FROM s{f} LEFT JOIN m{f} USING (label)")
    return f"""WITH {tb.sql_readings()},
wide AS (SELECT start_ts, epoch, {cells}, {extra} FROM readings GROUP BY start_ts, epoch),
{', '.join(ctes)}
{' UNION ALL '.join(parts)}"""


CHANNELS_SHORT = [c.split("_")[0] for c in CHANNELS]
FAMILY_SQL = _sql_family()


@query("read_frequencies", FAMILY_SQL)
def read_frequencies(spark, sf_dir):
    base = _write_family(spark, sf_dir)
    paths = {f: readers.frequency_path(base, f, "datetime") for f in FREQUENCIES}
    return _family_rows(readers.read_frequencies(spark, paths))


@query("read_frequencies_datetime", FAMILY_SQL)
def read_frequencies_datetime(spark, sf_dir):
    found = readers.read_frequencies(spark, _write_family(spark, sf_dir), "datetime")
    return _family_rows({f: df.withColumn("Start_Timestamp", ft.epoch_seconds("Start")) for f, df in found.items()})


@query("read_frequencies_timestamp", FAMILY_SQL)
def read_frequencies_timestamp(spark, sf_dir):
    return _family_rows(readers.read_frequencies(spark, _write_family(spark, sf_dir), "timestamp"))


@query("build_frequencies", FAMILY_SQL)
def build_frequencies(spark, sf_dir):
    return _family_rows(resample.build_frequencies(clean.sentinel_to_null(_public_hourly(spark, sf_dir))))


HOURLY_SQL = f"""WITH {tb.sql_hourly()}
SELECT epoch, {', '.join(CHANNELS)} FROM hourly"""


@query("read_table", HOURLY_SQL)
def read_table(spark, sf_dir):
    path = new_path(spark, "hourly")
    writers.write_table(tb.hourly(spark, sf_dir), path, "parquet")
    return readers.read_table(spark, path).select(tb.epoch(), *CHANNELS)


@query(
    "convert_parquet_to_csv",
    f"""WITH {tb.sql_readings()} SELECT pollutant || '.csv' AS file, epoch, value FROM readings""",
)
def convert_parquet_to_csv(spark, sf_dir):
    source, target = new_path(spark, "parquet"), new_path(spark, "csv")
    base = tb.readings(spark, sf_dir)
    for name in POLLUTANTS:
        part = base.filter(F.col("pollutant") == name).select(tb.epoch(), "value")
        writers.write_table(part, f"{source}/{name}.parquet", "parquet")
    report = writers.convert_parquet_to_csv(spark, source, target)
    parts = []
    for row in report.collect():  # one row per file of the folder
        if row["error"]:
            raise RuntimeError(row["error"])
        csv = readers.read_table(spark, row["target"], spark.read.parquet(row["source"]).schema)
        parts.append(csv.withColumn("file", F.lit(posixpath.basename(row["target"]))))
    return reduce(DataFrame.unionByName, parts)


@query(
    "write_flavours",
    f"""WITH {tb.sql_hourly()}
SELECT 'datetime' AS flavour, 7 AS n_columns, epoch, {', '.join(CHANNELS)} FROM hourly
UNION ALL SELECT 'timestamp', 7 - 1, epoch, {', '.join(CHANNELS)} FROM hourly""",
)
def write_flavours(spark, sf_dir):
    # ``epoch`` is kept in both flavours, ``start_ts`` only in the datetime one.
    table = tb.hourly(spark, sf_dir).select("start_ts", tb.epoch(), *CHANNELS)
    paths = writers.write_flavours(table, new_path(spark, "flavours"), "H", "start_ts", "parquet")
    parts = []
    for flavour, path in paths.items():
        back = readers.read_table(spark, path)
        parts.append(
            back.select(
                F.lit(flavour).alias("flavour"), F.lit(len(back.columns)).alias("n_columns"), "epoch", *CHANNELS
            )
        )
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------ columns and time


@query(
    "prefix_columns",
    f"""WITH {tb.sql_readings()}
SELECT epoch, code AS "AIR-Pollutant", value AS "AIR-Value", 'ug.m-3' AS "AIR-Unit",
 CASE WHEN value = -999 THEN -1 ELSE 1 END AS "AIR-Validity", 1 + code % 3 AS "AIR-Verification"
FROM readings""",
)
def prefix_columns(spark, sf_dir):
    named = fc.prefix_columns(tb.raw_readings(spark, sf_dir), "AIR")
    return named.select(tb.epoch("Start"), *[f"`{c}`" for c in named.columns if c.startswith("AIR-")])


@query(
    "drop_columns",
    f"""WITH {tb.sql_readings()}
SELECT code AS "Pollutant", epoch AS start_epoch, epoch + 3600 AS end_epoch, value AS "Value", 'ug.m-3' AS "Unit",
 CASE WHEN value = -999 THEN -1 ELSE 1 END AS "Validity", 1 + code % 3 AS "Verification" FROM readings""",
)
def drop_columns(spark, sf_dir):
    kept = fc.drop_columns(tb.raw_readings(spark, sf_dir))
    stamped = kept.withColumns({"start_epoch": ft.epoch_seconds("Start"), "end_epoch": ft.epoch_seconds("End")})
    return fc.drop_columns(stamped, ["Start", "End", "absent"])


@query(
    "move_to_front",
    f"""WITH {tb.sql_hourly()}
SELECT epoch, pm25_value, pm10_value, no2_value, o3_value, so2_value, 'so2_value,epoch' AS first_two FROM hourly""",
)
def move_to_front(spark, sf_dir):
    moved = fc.move_to_front(tb.hourly(spark, sf_dir).withColumn("epoch", ft.epoch_seconds("start_ts")), ["so2_value", "epoch"])
    return moved.withColumn("first_two", F.lit(",".join(moved.columns[:2]))).drop("start_ts")


@query("select_columns", f"WITH {tb.sql_hourly()} SELECT epoch, so2_value, no2_value FROM hourly")
def select_columns(spark, sf_dir):
    table = tb.hourly(spark, sf_dir).withColumn("epoch", ft.epoch_seconds("start_ts"))
    return fc.select_columns(table, ["epoch", "so2_value", "no2_value"])


@query(
    "to_epoch_seconds",
    f"""SELECT o_orderkey, CAST(floor(epoch_us(o_orderdate - INTERVAL 30 YEAR) / 1000000) AS BIGINT) AS "Start_Timestamp",
 CAST(floor(epoch_us(o_orderdate) / 1000000) AS BIGINT) AS "End_Timestamp" FROM orders""",
)
def to_epoch_seconds(spark, sf_dir):
    # Moved 30 years back, the start times fall on both sides of 1970.
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    interval = orders.select(
        "o_orderkey",
        (F.col("o_orderdate") - F.expr("INTERVAL 30 YEAR")).alias("Start"),
        F.col("o_orderdate").alias("End"),
    )
    return ft.to_epoch_seconds(interval, ["Start", "End"]).select("o_orderkey", "Start_Timestamp", "End_Timestamp")


@query(
    "parse_time",
    """SELECT 'H' AS freq, event_id AS id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS epoch FROM events
UNION ALL SELECT 'D', o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) FROM orders""",
)
def parse_time(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    hours = events.select(F.col("event_id").alias("id"), F.date_format("ts", ft.HOUR_FORMAT).alias("Start"))
    days = orders.select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", ft.DAY_FORMAT).alias("Start"))
    parts = [
        ft.parse_time(df, "Start", f).select(F.lit(f).alias("freq"), "id", tb.epoch("Start"))
        for f, df in (("H", hours), ("D", days))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "set_time_key",
    f"""WITH {tb.sql_hourly()}
SELECT epoch, CAST(row_number() OVER (ORDER BY epoch) - 1 AS BIGINT) AS pos, coalesce(lag(epoch) OVER (ORDER BY epoch), -1) AS prev_epoch
FROM hourly""",
)
def set_time_key(spark, sf_dir):
    stamped = tb.hourly(spark, sf_dir).select(tb.epoch())
    placed = place(stamped, "epoch", start="pos", before={"prev_epoch": "epoch"})
    return placed.withColumn("prev_epoch", F.coalesce("prev_epoch", F.lit(-1).cast("bigint")))


@query(
    "select_features_target",
    f"""WITH {tb.sql_daily()}
SELECT epoch, round(pm25_value, 6) AS label, round(no2_value, 6) AS f0, round(o3_value, 6) AS f1,
 round(so2_value, 6) AS f2, round(pm10_value, 6) AS f3 FROM filled""",
)
def select_features_target(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    picked = fc.select_features_target(tb.daily_filled(spark, sf_dir), keep=["start_ts"])
    arr = picked.withColumn("a", vector_to_array("features"))
    return rounded(arr.select(tb.epoch(), "label", *[F.col("a")[i].alias(f"f{i}") for i in range(4)]))


def _sql_time_features(freq: str, column: str = "epoch") -> str:
    out = []
    for p in ft.PERIODS_BY_FREQUENCY[freq]:
        for fn in ("sin", "cos"):
            angle = f"CAST({column} AS DOUBLE) * CAST({2 * ft.math.pi / ft.PERIODS[p]!r} AS DOUBLE)"
            out.append(f"round({fn}({angle}), 6) AS {p}_{fn}")
    return ", ".join(out)


for _freq in FREQUENCIES:

    @query(f"add_time_features_{_freq.lower()}", f"WITH {tb.sql_hourly()} SELECT epoch, {_sql_time_features(_freq)} FROM hourly")
    def add_time_features(spark, sf_dir, freq=_freq):
        return rounded(ft.add_time_features(tb.hourly(spark, sf_dir).select(tb.epoch()), "epoch", freq))


@query(
    "preprocess_time_series",
    f"WITH {tb.sql_hourly()} SELECT epoch, {', '.join(CHANNELS)}, {_sql_time_features('H')} FROM hourly",
)
def preprocess_time_series(spark, sf_dir):
    made = ft.preprocess_time_series(tb.hourly(spark, sf_dir), "start_ts", "H")
    return rounded(made.withColumn("epoch", ft.epoch_seconds("start_ts")).drop("start_ts"))


# ------------------------------------------------------------ missing data


@query("sentinel_to_null", f"WITH {tb.sql_hourly()} SELECT epoch, {', '.join(CHANNELS)} FROM clean")
def sentinel_to_null(spark, sf_dir):
    return clean.sentinel_to_null(tb.hourly(spark, sf_dir)).select(tb.epoch(), *CHANNELS)


@query(
    "impute_missing",
    f"""WITH {tb.sql_hourly()}
SELECT epoch, {', '.join(f'round(coalesce({c}, avg({c}) OVER ()), 6) AS {c}' for c in CHANNELS)} FROM clean""",
)
def impute_missing(spark, sf_dir):
    return rounded(clean.impute_missing(tb.hourly_clean(spark, sf_dir), CHANNELS).select(tb.epoch(), *CHANNELS))


@query(
    "impute_missing_per_key",
    f"""WITH {tb.sql_hourly('user_id')}
SELECT user_id, epoch, {', '.join(f'round(coalesce({c}, avg({c}) OVER (PARTITION BY user_id)), 6) AS {c}' for c in CHANNELS)}
FROM clean""",
)
def impute_missing_per_key(spark, sf_dir):
    filled = clean.impute_missing(tb.hourly_clean(spark, sf_dir, ["user_id"]), CHANNELS, ["user_id"])
    return rounded(filled.select("user_id", tb.epoch(), *CHANNELS))


@query(
    "drop_null_rows",
    f"WITH {tb.sql_hourly()} SELECT epoch, {', '.join(CHANNELS)} FROM clean WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in CHANNELS),
)
def drop_null_rows(spark, sf_dir):
    return clean.drop_null_rows(tb.hourly_clean(spark, sf_dir)).select(tb.epoch(), *CHANNELS)


@query(
    "filter_validity",
    f"WITH {tb.sql_readings()} SELECT code, epoch, value FROM readings WHERE value <> -999",
)
def filter_validity(spark, sf_dir):
    kept = clean.filter_validity(tb.raw_readings(spark, sf_dir))
    return kept.select(F.col("Pollutant").alias("code"), tb.epoch("Start"), F.col("Value").alias("value"))


_IQR_SQL = """bounds AS (SELECT q1, q3, q1 - 1.5::DOUBLE * (q3 - q1) AS lower, q3 + 1.5::DOUBLE * (q3 - q1) AS upper
 FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))"""


@query(
    "iqr_outliers",
    f"""WITH {_IQR_SQL} SELECT event_id, value, round(lower, 6) AS lower, round(upper, 6) AS upper
FROM events, bounds WHERE value < lower OR value > upper""",
)
def iqr_outliers(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    return rounded(clean.iqr_outliers(events, "value").drop("q1", "q3"))


@query(
    "outlier_share",
    f"""WITH {tb.sql_readings()},
bounds AS (SELECT pollutant, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM readings GROUP BY 1)
SELECT pollutant, count(*) FILTER (value < q1 - 1.5::DOUBLE * (q3 - q1) OR value > q3 + 1.5::DOUBLE * (q3 - q1)) AS n_outliers,
 round(100::DOUBLE * count(*) FILTER (value < q1 - 1.5::DOUBLE * (q3 - q1) OR value > q3 + 1.5::DOUBLE * (q3 - q1)) / count(*), 6) AS pct_outliers
FROM readings JOIN bounds USING (pollutant) GROUP BY pollutant""",
)
def outlier_share(spark, sf_dir):
    return rounded(clean.outlier_share(tb.readings(spark, sf_dir), "value", ["pollutant"]))


# ------------------------------------------------------------ merging


def _prefixed_tables(spark, sf_dir):
    raw = tb.raw_readings(spark, sf_dir)
    out = []
    for name in POLLUTANTS:
        part = raw.filter(F.col("Pollutant") == tb.POLLUTANT_CODE[name]).select("Start", "End", "Value")
        out.append(fc.prefix_columns(part, PUBLIC_PREFIX[name]))
    return out


MERGED_SQL = f"""WITH {tb.sql_hourly()}
SELECT epoch, epoch + 3600 AS end_epoch, {', '.join(CHANNELS)} FROM hourly"""


@query("merge_on_interval", MERGED_SQL)
def merge_on_interval(spark, sf_dir):
    merged = fc.to_internal(merge.merge_on_interval(_prefixed_tables(spark, sf_dir)))
    return merged.select(tb.epoch("Start"), tb.epoch("End", "end_epoch"), *CHANNELS)


# A right join loses earlier tables' rows that the next table lacks.
_MERGED = [f"{name}_value" for name in POLLUTANTS]
_CHAINED = ", ".join(
    f"CASE WHEN {' AND '.join(f'{later} IS NOT NULL' for later in _MERGED[i + 1 :]) or 'TRUE'} THEN {c} END AS {c}" for i, c in enumerate(_MERGED)
)

for _how in ("inner", "left", "right"):
    _cond = {
        "inner": " AND ".join(f"{c} IS NOT NULL" for c in CHANNELS),
        "left": f"{_MERGED[0]} IS NOT NULL",
        "right": f"{_MERGED[-1]} IS NOT NULL",
    }[_how]

    @query(
        f"merge_on_interval_{_how}",
        f"WITH {tb.sql_hourly()} SELECT epoch, {_CHAINED if _how == 'right' else ', '.join(CHANNELS)} FROM hourly WHERE {_cond}",
    )
    def merge_on_interval_how(spark, sf_dir, how=_how):
        merged = fc.to_internal(merge.merge_on_interval(_prefixed_tables(spark, sf_dir), how=how))
        return merged.select(tb.epoch("Start"), *CHANNELS)


@query("merge_by_pivot", MERGED_SQL)
def merge_by_pivot(spark, sf_dir):
    wide = merge.merge_by_pivot(tb.raw_readings(spark, sf_dir), tb.CODE_POLLUTANT, ["Value"], by="Pollutant")
    wide = wide.withColumnsRenamed({c: to_internal_name(c.replace("_Value", "_value")) for c in wide.columns})
    return wide.select(tb.epoch("Start"), tb.epoch("End", "end_epoch"), *CHANNELS)


# ------------------------------------------------------------ frequencies

_LABEL_SQL = {
    "D": "CAST(date_trunc('day', {c}) AS DATE)",
    "W": "CAST(date_trunc('week', {c}) + INTERVAL 6 DAY AS DATE)",
    "M": "CAST(last_day({c}) AS DATE)",
}


def _sql_resample(freq: str) -> str:
    medians = ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS {c}" for c in CHANNELS)
    label = _LABEL_SQL[freq].format(c="start_ts")
    if freq == "M":
        spine = "SELECT CAST(last_day(d) AS DATE) AS label FROM (SELECT unnest(generate_series(CAST(date_trunc('month', min(label)) AS TIMESTAMP), CAST(max(label) AS TIMESTAMP), INTERVAL 1 MONTH)) AS d FROM m)"
    else:
        step = {"D": 1, "W": 7}[freq]
        spine = f"SELECT CAST(unnest(generate_series(CAST(min(label) AS TIMESTAMP), CAST(max(label) AS TIMESTAMP), INTERVAL {step} DAY)) AS DATE) AS label FROM m"
    return f"""WITH {tb.sql_daily()},
m AS (SELECT {label} AS label, {medians} FROM daily GROUP BY 1), s AS ({spine})
SELECT strftime(label, '%Y-%m-%d') AS day, CAST(epoch(CAST(label AS TIMESTAMP)) AS BIGINT) AS epoch, {', '.join(CHANNELS)}
FROM s LEFT JOIN m USING (label)"""


for _freq in ("D", "W", "M"):

    @query(f"resample_median_{_freq.lower()}", _sql_resample(_freq))
    def resample_median(spark, sf_dir, freq=_freq):
        made = resample.resample_median(tb.daily(spark, sf_dir), "start_ts", freq, CHANNELS)
        return rounded(made.select(tb.day_text(), F.col("start_ts_Timestamp").alias("epoch"), *CHANNELS))


@query(
    "resample_median_per_key",
    f"""WITH m AS (SELECT user_id, date_trunc('day', ts) AS label, round(quantile_cont(value, 0.5), 6) AS value FROM events GROUP BY 1, 2),
s AS (SELECT user_id, unnest(generate_series(min(label), max(label), INTERVAL 1 DAY)) AS label FROM m GROUP BY 1)
SELECT user_id, strftime(label, '%Y-%m-%d') AS day, value FROM s LEFT JOIN m USING (user_id, label)""",
)
def resample_median_per_key(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "value")
    made = resample.resample_median(events, "ts", "D", ["value"], keys=["user_id"])
    return rounded(made.select("user_id", tb.day_text("ts"), "value"))


@query("hourly_passthrough", HOURLY_SQL.replace("SELECT epoch,", 'SELECT epoch AS "Start_Timestamp",'))
def hourly_passthrough(spark, sf_dir):
    interval = tb.hourly(spark, sf_dir).withColumnRenamed("start_ts", "Start").withColumn("End", F.col("Start") + F.expr("INTERVAL 1 HOUR"))
    return resample.hourly_passthrough(interval).drop("Start")


@query(
    "as_frequency",
    f"""WITH {tb.sql_daily()},
s AS (SELECT unnest(generate_series(min(start_ts), max(start_ts), INTERVAL 1 DAY)) AS start_ts FROM daily)
SELECT CAST(epoch(s.start_ts) AS BIGINT) AS epoch, pm25_value FROM s LEFT JOIN daily ON daily.start_ts = s.start_ts""",
)
def as_frequency(spark, sf_dir):
    return resample.as_frequency(tb.daily(spark, sf_dir), "start_ts", "D").select(tb.epoch(), "pm25_value")


@query(
    "as_frequency_per_key",
    """WITH h AS (SELECT user_id, date_trunc('hour', ts) AS h, max(value) AS value FROM events GROUP BY 1, 2),
s AS (SELECT user_id, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM h GROUP BY 1)
SELECT s.user_id, CAST(epoch(s.h) AS BIGINT) AS epoch, value FROM s LEFT JOIN h ON h.user_id = s.user_id AND h.h = s.h""",
)
def as_frequency_per_key(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start_ts")
    per_hour = events.groupBy("user_id", hour).agg(F.max("value").alias("value"))
    return resample.as_frequency(per_hour, "start_ts", "H", ["user_id"]).select("user_id", tb.epoch(), "value")


@query(
    "with_position",
    """SELECT l_shipdate_epoch, n, CAST(min_pos AS BIGINT) AS min_pos, CAST(max_pos AS BIGINT) AS max_pos FROM (
SELECT CAST(epoch(l_shipdate) AS BIGINT) AS l_shipdate_epoch, count(*) AS n, min(pos) AS min_pos, max(pos) AS max_pos FROM (
SELECT l_shipdate, row_number() OVER (ORDER BY l_shipdate) - 1 AS pos FROM lineitem) GROUP BY 1)""",
)
def with_position_query(spark, sf_dir):
    # Equal times may take their positions in any order; the range per time is fixed.
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(tb.epoch("l_shipdate", "l_shipdate_epoch"))
    placed = with_position(items, "l_shipdate_epoch")
    return placed.groupBy("l_shipdate_epoch").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos")
    )


@query(
    "with_position_per_key",
    """SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS pos FROM events""",
)
def with_position_per_key(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    return with_position(events, "event_id", ["user_id"])
