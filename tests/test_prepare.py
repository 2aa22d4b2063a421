import datetime

import numpy as np
import pandas as pd
import pytest

from conftest import series
from tidemark.functions import columns as fc
from tidemark.functions import time as ft
from tidemark.operators import clean, merge, resample
from tidemark.schema import METADATA_COLUMNS, RAW_SCHEMA, frequency_schema, to_internal_name, to_public_name
from tidemark.session import new_path
from tidemark.sources import readers, writers


def test_prefix_drop_front(spark):
    df = spark.createDataFrame([], RAW_SCHEMA)
    named = fc.prefix_columns(df, "NO2")
    assert "NO2-Value" in named.columns and "Value" not in named.columns
    with pytest.raises(ValueError):
        fc.prefix_columns(df, 3)
    assert not set(METADATA_COLUMNS) & set(fc.drop_columns(df).columns)
    assert fc.drop_columns(df, ["absent"]).columns == df.columns
    assert fc.move_to_front(df, ["Value", "Unit"]).columns[:3] == ["Value", "Unit", "Samplingpoint"]
    assert fc.select_columns(df, ["Unit"], head=3).columns == ["Unit"]


def test_names_round_trip():
    for name in frequency_schema("H").names:
        assert to_public_name(to_internal_name(name)) == name


def test_epoch_before_1970(spark):
    df = spark.createDataFrame([("1969-12-31 23:59:59.5",), ("2013-01-31",)], "Start string")
    got = [r[0] for r in ft.to_epoch_seconds(df, ["Start"]).orderBy("Start").collect()]
    assert got == [-1, 1359590400]


def test_parse_time_and_unknown_frequency(spark):
    df = spark.createDataFrame([("2020-02-29",)], "Start string")
    assert ft.parse_time(df, "Start", "D").first()[0] == datetime.datetime(2020, 2, 29)
    with pytest.raises(ValueError):
        ft.parse_time(df, "Start", "Q")


def test_time_features(spark, frame):
    got = ft.add_time_features(frame([(None, 86400.0 / 4)]), "value", "D").first()
    assert np.isclose(got["day_sin"], 1.0) and np.isclose(got["day_cos"], 0.0)


def test_sentinel_nan_and_mean(spark, frame):
    rows = [("a", None, 1.0), ("a", None, -999.0), ("a", None, float("nan")), ("a", None, 3.0), ("b", None, None)]
    df = clean.sentinel_to_null(frame(rows, "k string, ts timestamp, value double"))
    assert df.filter("value is null").count() == 3
    filled = clean.impute_missing(df, ["value"])
    assert sorted(r.value for r in filled.collect()) == [1.0, 2.0, 2.0, 2.0, 3.0]
    # A series without any value stays empty when filled by itself.
    own = clean.impute_missing(df, ["value"], ["k"]).filter("k = 'b'").first()
    assert own.value is None
    assert clean.drop_null_rows(df, ["value"]).count() == 2


def test_outliers(spark, frame, path):
    df = frame(series(100, fn=lambda i: 1000 if i == 50 else i))
    assert [r.value for r in clean.iqr_outliers(df, "value").collect()] == [1000.0]
    share = clean.outlier_share(df, "value").first()
    assert (share.n_outliers, share.pct_outliers) == (1, 1.0)


def make_pair(spark):
    left = spark.createDataFrame([(1, 1, 10.0), (2, 2, 20.0), (None, 3, 30.0)], "Start int, End int, a double")
    right = spark.createDataFrame([(2, 2, 1.0), (2, 2, 2.0), (None, 3, 3.0), (9, 9, 4.0)], "Start int, End int, b double")
    return left, right


@pytest.mark.parametrize("how, rows", [("outer", 5), ("inner", 3), ("left", 4), ("right", 4)])
def test_merge_equals_pandas(spark, how, rows):
    left, right = make_pair(spark)
    got = merge.merge_on_interval([left, right], how=how, sort=True).toPandas()
    want = left.toPandas().merge(right.toPandas(), on=["Start", "End"], how=how)
    order = ["Start", "End", "a", "b"]
    key = lambda df: sorted(tuple(-1 if pd.isna(v) else v for v in r) for r in df[order].itertuples(index=False))
    assert len(got) == rows and key(got) == key(want)


def test_merge_errors(spark):
    left, _ = make_pair(spark)
    with pytest.raises(ValueError):
        merge.merge_on_interval([])
    with pytest.raises(ValueError):
        merge.merge_on_interval([left], how="cross")
    with pytest.raises(ValueError):
        merge.merge_on_interval([left, left])


@pytest.mark.parametrize("freq, rule", [("D", "D"), ("W", "W"), ("M", "ME")])
def test_resample_equals_pandas(spark, frame, path, freq, rule):
    noise = np.cos(np.arange(2000) * 3.7)
    rows = [r for i, r in enumerate(series(2000, start="2023-12-28", fn=lambda i: noise[i])) if not 300 <= i < 700]
    got = resample.resample_median(frame(rows), "ts", freq).orderBy("ts").toPandas()
    want = pd.DataFrame(rows, columns=["ts", "value"]).set_index("ts").value.resample(rule).median()
    assert [str(d) for d in got.ts] == [str(d.date()) for d in want.index]
    assert np.allclose(got.value, want, equal_nan=True)
    assert got.ts_Timestamp.tolist() == [int(d.timestamp()) for d in want.index]


def test_resample_hour_is_refused(spark, frame):
    with pytest.raises(ValueError):
        resample.resample_median(frame(series(3)), "ts", "H")


def test_as_frequency(spark, frame, path):
    rows = [r for i, r in enumerate(series(30)) if i not in (4, 5, 20)]
    got = resample.as_frequency(frame(rows), "ts", "H").orderBy("ts").toPandas()
    want = pd.DataFrame(rows, columns=["ts", "value"]).set_index("ts").asfreq("h")
    assert got.ts.tolist() == want.index.tolist()
    assert np.allclose(got.value, want.value, equal_nan=True)


def test_as_frequency_drops_off_grid_and_refuses_repeats(spark, frame, path):
    rows = series(5) + [(datetime.datetime(2024, 1, 1, 1, 30), 9.0)]
    assert resample.as_frequency(frame(rows), "ts", "H").count() == 5
    with pytest.raises(Exception, match="repeated time stamp"):
        resample.as_frequency(frame(series(5) + series(1)), "ts", "H").collect()


def test_month_grid(spark, frame, path):
    days = [datetime.datetime(2013, 1, 31), datetime.datetime(2013, 2, 28), datetime.datetime(2013, 5, 31)]
    got = resample.as_frequency(frame([(d, 1.0) for d in days]), "ts", "M").orderBy("ts").collect()
    assert [str(r.ts) for r in got] == ["2013-01-31", "2013-02-28", "2013-03-31", "2013-04-30", "2013-05-31"]


def test_build_frequencies_refuses_empty(spark, frame):
    with pytest.raises(ValueError):
        resample.build_frequencies(frame([]), "ts")


def test_missing_files(spark):
    with pytest.raises(FileNotFoundError, match="missing input"):
        readers.read_pollutants(spark, {"pm25": "/nowhere/a.csv"})
    with pytest.raises(FileNotFoundError):
        readers.read_frequencies(spark, "/nowhere")


def test_flavours_round_trip(spark, frame):
    base = new_path(spark, "t")
    df = frame(series(5)).withColumnRenamed("ts", "Start").withColumn("Start_Timestamp", ft.epoch_seconds("Start"))
    paths = writers.write_flavours(df, base, "H", fmt="parquet")
    assert readers.read_table(spark, paths["timestamp"]).columns == ["value", "Start_Timestamp"]
    assert readers.read_table(spark, paths["datetime"]).count() == 5
    with pytest.raises(TypeError):
        writers.write_flavours(df, 3, "H")


def test_times_in_text_are_plain(spark, frame):
    base = new_path(spark, "t")
    df = frame(series(2, start="2013-01-31")).withColumnRenamed("ts", "Start")
    paths = writers.write_flavours(df, base, "H")
    lines = {r.value for r in spark.read.text(paths["datetime"]).collect()}
    assert "2013-01-31 01:00:00,1.0" in lines
    back = readers.read_table(spark, paths["datetime"], df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_convert_reports_broken_files(spark):
    source, target = new_path(spark, "in"), new_path(spark, "out")
    spark.range(3).write.parquet(f"{source}/good.parquet")
    spark.createDataFrame([("x",)], "v string").write.text(f"{source}/bad.parquet")
    report = {r.source.rsplit("/", 1)[1]: r for r in writers.convert_parquet_to_csv(spark, source, target).collect()}
    assert report["good.parquet"].error is None and report["bad.parquet"].error
    assert spark.read.option("header", True).csv(f"{target}/good.csv").count() == 3


def test_filter_validity(spark):
    df = spark.createDataFrame([(1, -1), (2, 1), (3, None)], "id int, Validity int")
    assert [r.id for r in clean.filter_validity(df).collect()] == [2]
