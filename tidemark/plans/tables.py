"""Sensor tables derived from the given star-schema tables, in Spark and as SQL text.

Five event types play the five pollutants at hourly grain, five order priorities
play them at daily grain. Both are grouped over the whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import epoch_seconds
from ..operators.clean import impute_missing, sentinel_to_null
from ..operators.merge import merge_by_pivot
from ..schema import CHANNELS, RAW_SCHEMA, SENTINEL

# Which source category plays which pollutant, and its code.
EVENT_POLLUTANT = {"purchase": "pm25", "view": "pm10", "click": "no2", "error": "o3", "signup": "so2"}
PRIORITY_POLLUTANT = {"1-URGENT": "pm25", "2-HIGH": "pm10", "3-MEDIUM": "no2", "4-NOT SPECIFIED": "o3", "5-LOW": "so2"}
POLLUTANT_CODE = {"pm25": 6001, "pm10": 5, "no2": 8, "o3": 7, "so2": 1}
CODE_POLLUTANT = {code: name for name, code in POLLUTANT_CODE.items()}


def _lookup(column, table):
    out = None
    for key, value in table.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out


def readings(spark: SparkSession, sf_dir: str, keys=()) -> DataFrame:
    """Hourly readings ``keys…, pollutant, code, start_ts, value`` with injected sentinels."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start_ts")
    grouped = events.groupBy(*keys, "event_type", hour).agg(F.max("value").alias("value"))
    name = _lookup(F.col("event_type"), EVENT_POLLUTANT)
    coded = grouped.withColumn("pollutant", name).withColumn("code", _lookup(F.col("pollutant"), POLLUTANT_CODE))
    hours = F.expr("unix_seconds(start_ts) div 3600")
    value = F.when((hours + F.col("code")) % 97 == 0, SENTINEL).otherwise(F.col("value"))
    return coded.select(*keys, "pollutant", "code", "start_ts", value.alias("value"))


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings in the twelve columns of a raw pollutant file."""
    base = readings(spark, sf_dir)
    return base.select(
        F.concat(F.lit("SP-"), F.col("pollutant")).alias("Samplingpoint"),
        F.col("code").alias("Pollutant"),
        F.col("start_ts").alias("Start"),
        (F.col("start_ts") + F.expr("INTERVAL 1 HOUR")).alias("End"),
        F.col("value").alias("Value"),
        F.lit("ug.m-3").alias("Unit"),
        F.lit("hour").alias("AggType"),
        F.when(F.col("value") == SENTINEL, -1).otherwise(1).alias("Validity"),
        (F.lit(1) + F.col("code") % 3).alias("Verification"),
        F.col("start_ts").alias("ResultTime"),
        F.lit(100.0).alias("DataCapture"),
        F.lit("log").alias("FkObservationLog"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in RAW_SCHEMA])


def hourly(spark: SparkSession, sf_dir: str, keys=()) -> DataFrame:
    """Wide hourly table ``keys…, start_ts, <pollutant>_value`` with sentinels."""
    long = readings(spark, sf_dir, keys)
    return merge_by_pivot(long, {p: p for p in POLLUTANT_CODE}, on=[*keys, "start_ts"])


def hourly_clean(spark: SparkSession, sf_dir: str, keys=()) -> DataFrame:
    """Wide hourly table with sentinels turned into nulls."""
    return sentinel_to_null(hourly(spark, sf_dir, keys), CHANNELS)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide daily table ``start_ts, <pollutant>_value`` over several years; days without orders are gaps."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("start_ts")
    long = orders.select(
        day, _lookup(F.col("o_orderpriority"), PRIORITY_POLLUTANT).alias("pollutant"), (F.col("o_totalprice") / 1000.0).alias("value")
    )
    return merge_by_pivot(long, {p: p for p in POLLUTANT_CODE}, on=["start_ts"])


def daily_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily table with the column means in place of nulls: the input of the models."""
    return impute_missing(daily(spark, sf_dir), CHANNELS)


def target_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily target without nulls: ``start_ts, value``."""
    return daily(spark, sf_dir).select("start_ts", F.col("pm25_value").alias("value")).filter(F.col("value").isNotNull())


def epoch(column: str = "start_ts", name: str = "epoch"):
    """Epoch seconds, the form in which registered queries report times."""
    return epoch_seconds(column).alias(name)


def day_text(column: str = "start_ts", name: str = "day"):
    """``yyyy-MM-dd`` text, the form in which registered queries report dates."""
    return F.date_format(F.col(column), "yyyy-MM-dd").alias(name)


# ---------------------------------------------------------------- SQL text

_EPOCH = "CAST(epoch(date_trunc('hour', ts)) AS BIGINT)"


def _case(column, table):
    whens = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items())
    return f"CASE {column} {whens} END"


def sql_readings(keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    code = _case("event_type", {k: POLLUTANT_CODE[v] for k, v in EVENT_POLLUTANT.items()})
    return f"""readings AS (
  SELECT {lead}pollutant, code, start_ts, epoch,
         CASE WHEN (epoch // 3600 + code) % 97 = 0 THEN CAST(-999 AS DOUBLE) ELSE value END AS value
  FROM (SELECT {lead}{_case('event_type', EVENT_POLLUTANT)} AS pollutant, {code} AS code,
               date_trunc('hour', ts) AS start_ts, {_EPOCH} AS epoch, max(value) AS value
        FROM events GROUP BY ALL))"""


def _sql_pivot(source: str, keys: str, cols: str, value: str = "value") -> str:
    lead = f"{keys}, " if keys else ""
    cells = ", ".join(f"max(CASE WHEN pollutant = '{p}' THEN {value} END) AS {p}_value" for p in POLLUTANT_CODE)
    return f"SELECT {lead}{cols}, {cells} FROM {source} GROUP BY {lead}{cols}"


def sql_hourly(keys: str = "") -> str:
    """``readings`` and ``hourly`` (sentinels kept) and ``clean`` (sentinels null)."""
    lead = f"{keys}, " if keys else ""
    nulls = ", ".join(f"nullif({p}_value, -999) AS {p}_value" for p in POLLUTANT_CODE)
    return f"""{sql_readings(keys)},
hourly AS ({_sql_pivot('readings', keys, 'start_ts, epoch')}),
clean AS (SELECT {lead}start_ts, epoch, {nulls} FROM hourly)"""


def sql_daily() -> str:
    """``daily`` with nulls, ``filled`` with column means and ``series`` (target without nulls)."""
    filled = ", ".join(f"coalesce({p}_value, avg({p}_value) OVER ()) AS {p}_value" for p in POLLUTANT_CODE)
    long = f"""SELECT date_trunc('day', o_orderdate) AS start_ts,
       CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS epoch,
       {_case('o_orderpriority', PRIORITY_POLLUTANT)} AS pollutant, o_totalprice / CAST(1000 AS DOUBLE) AS value FROM orders"""
    return f"""long_daily AS ({long}),
daily AS ({_sql_pivot('long_daily', '', 'start_ts, epoch')}),
filled AS (SELECT start_ts, epoch, {filled} FROM daily),
series AS (SELECT start_ts, epoch, pm25_value AS value FROM daily WHERE pm25_value IS NOT NULL)"""
