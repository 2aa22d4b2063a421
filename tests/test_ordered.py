import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import series
from tidemark.operators import ordered, sequence, split
from tidemark.operators.quantiles import grouped_quantiles

NOISE = np.sin(np.arange(400) * 12.9898) * 43758.5453 % 1.0


def skewed(n=400):
    """One key holds about a third of the rows, one has a single row."""
    keys = ["hot" if i % 3 == 0 else f"k{i % 7}" for i in range(n - 1)] + ["alone"]
    return [(k, *r) for k, r in zip(keys, series(n, fn=lambda i: NOISE[i]))]


SCHEMA = "k string, ts timestamp, value double"


def test_position_equals_pandas(spark, frame, path):
    rows = skewed()
    got = ordered.with_position(frame(rows, SCHEMA), "ts", ["k"], total="n").toPandas().sort_values("ts")
    want = pd.DataFrame(rows, columns=["k", "ts", "value"]).sort_values("ts")
    assert got.pos.tolist() == want.groupby("k").cumcount().tolist()
    assert got.n.tolist() == want.groupby("k").k.transform("size").tolist()


def test_position_of_null_key_and_pre_1970(spark, frame, path):
    rows = series(60, start="1969-12-31T00:00:00", key=None)
    df = frame([(None if i % 2 else "a", *r) for i, r in enumerate(rows)], SCHEMA)
    got = ordered.with_position(df, "ts", ["k"]).toPandas()
    for _, part in got.groupby("k", dropna=False):
        assert sorted(part.pos) == list(range(30))


def test_neighbours(spark, frame, path):
    rows = skewed()
    got = ordered.place(frame(rows, SCHEMA), "ts", ["k"], before={"p": "value"}, after={"f": "value"}).toPandas()
    want = pd.DataFrame(rows, columns=["k", "ts", "value"]).sort_values("ts")
    got = got.sort_values("ts")
    assert np.allclose(got.p, want.groupby("k").value.shift(1), equal_nan=True)
    assert np.allclose(got.f, want.groupby("k").value.shift(-1), equal_nan=True)


def test_running_weight(spark, frame, path):
    df = frame(series(200, fn=lambda i: i % 5)).withColumn("w", F.col("value").cast("bigint"))
    got = ordered.place(df, "ts", start="s", total="t", weight="w").orderBy("ts").toPandas()
    assert got.s.tolist() == (got.w.cumsum() - got.w).tolist()
    assert set(got.t) == {got.w.sum()}


@pytest.mark.parametrize("window", [1, 2, 12, 40])
def test_rolling_equals_pandas(spark, frame, path, window):
    rows = skewed()
    got = sequence.rolling_mean_std(frame(rows, SCHEMA), "value", "ts", window, ["k"]).toPandas().sort_values("ts")
    want = pd.DataFrame(rows, columns=["k", "ts", "value"]).sort_values("ts").groupby("k").value.rolling(window)
    mean = want.mean().reset_index(level=0, drop=True).sort_index()
    std = want.std().reset_index(level=0, drop=True).sort_index()
    assert np.allclose(got.rolling_mean, mean, equal_nan=True)
    if window > 1:
        assert np.allclose(got.rolling_std, std, equal_nan=True)


def test_rolling_window_with_null_is_null(spark, frame, path):
    rows = series(30, fn=lambda i: None if i == 10 else i)
    got = sequence.rolling_mean_std(frame(rows), "value", "ts", 3).orderBy("ts").toPandas()
    assert got.index[got.rolling_mean.isna()].tolist() == [0, 1, 10, 11, 12]


def test_lag_and_differences(spark, frame, path):
    df = frame(series(100, fn=lambda i: i * i))
    lagged = sequence.lag(df, "value", "ts", 3).orderBy("ts").toPandas()
    assert np.allclose(lagged.value_lag3[3:], lagged.value[:-3])
    by_lag = sequence.difference(df, "value", "ts", 3).toPandas()
    assert by_lag.groupby("order").size().to_dict() == {1: 99, 2: 98, 3: 97}
    by_order = sequence.difference(df, "value", "ts", 3, mode="order").toPandas()
    assert set(by_order[by_order.order == 2]["diff"]) == {2.0}
    assert set(by_order[by_order.order == 3]["diff"]) == {0.0}
    with pytest.raises(ValueError):
        sequence.difference(df, "value", "ts", mode="other")


def test_decomposition_recovers_parts(spark, frame, path):
    season = np.sin(2 * np.pi * np.arange(24) / 24)
    df = frame(series(240, fn=lambda i: 5 + 0.1 * i + season[i % 24]))
    got = sequence.seasonal_decompose(df, "value", "ts", 24).orderBy("ts").toPandas()
    assert got.trend.isna().sum() == 24
    inner = got[12:-12]
    assert np.allclose(inner.trend, 5 + 0.1 * inner.index)
    assert np.allclose(got.seasonal, np.resize(season, 240), atol=1e-9)
    assert np.allclose(inner.resid, 0, atol=1e-9)


def test_decomposition_needs_two_periods(spark, frame):
    with pytest.raises(Exception, match="at least 48"):
        sequence.seasonal_decompose(frame(series(47)), "value", "ts", 24).collect()


def test_windows(spark, frame, path):
    got = sequence.create_windows(frame(series(50)), ["value"], "ts", 12).orderBy("pos").toPandas()
    assert len(got) == 50 - 12 - 1
    for row in got.itertuples():
        assert [v[0] for v in row.x] == list(range(row.pos, row.pos + 12))
        assert row.y[0] == row.pos + 12


def test_split_sizes(spark, frame, path):
    got = split.chronological_split(frame(series(119)), "ts").groupBy("split").count().toPandas()
    assert dict(zip(got.split, got["count"])) == {"train": 71, "validation": 23, "test": 25}
    with pytest.raises(ValueError):
        split.chronological_split(frame(series(5)), "ts", 0.8, 0.3)


def test_folds_expand(spark, frame, path):
    got = split.time_series_folds(frame(series(72)), "ts").toPandas()
    for fold, (train_end, test_end) in enumerate(split.fold_bounds(72)):
        part = got[got.fold == fold]
        assert sorted(part[part.role == "train"].pos) == list(range(train_end))
        assert sorted(part[part.role == "test"].pos) == list(range(train_end, test_end))


def test_quantiles_equal_numpy(spark, frame, path):
    rows = [(k, t, None if i % 11 == 0 else round(v, 1)) for i, (k, t, v) in enumerate(skewed())] + [("empty", None, None)] * 12
    df = frame(rows, SCHEMA)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r["value"] for r in grouped_quantiles(df, ["value"], probs, ["k"]).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "ts", "value"])
    assert set(got) == set(pdf.k)
    assert got["empty"] is None
    for k, part in pdf.groupby("k"):
        values = part.value.dropna()
        if len(values):
            assert np.allclose(got[k], np.quantile(values, probs))


def test_quantiles_with_one_dominant_value(spark, frame, path):
    rows = series(300, fn=lambda i: 7 if i % 3 else i)
    got = grouped_quantiles(frame(rows), ["value"], [0.25, 0.5, 0.75]).first()["value"]
    assert np.allclose(got, np.quantile([v for _, v in rows], [0.25, 0.5, 0.75]))


def awkward(n=600):
    """Null times, NaN-free ties and a time that nine rows in ten share."""
    import datetime

    day = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = None if i % 41 == 0 else day if i % 10 else day + datetime.timedelta(hours=int(NOISE[i % 400] * 50) - 20)
        rows.append((["a", "b"][i % 3 == 0], at, None if i % 17 == 0 else float(i)))
    return rows


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most", [1 << 12, 4])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_paths_agree_on_nulls_and_ties(spark, frame, monkeypatch, keys, most):
    df = frame(awkward(), SCHEMA).repartition(5)
    placed = lambda: ordered.place(df, "ts", keys, start="s", total="t", before={"p": "value"}, after={"f": "value"})
    rolled = lambda: sequence.lag(df, "value", "ts", 3, keys)
    plain = sorted_rows(placed()), sorted_rows(rolled())
    monkeypatch.setattr(ordered, "PLAIN_ROWS", 0)
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 17)
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ordered, "MAX_BUCKETS", most)
    assert (ordered.profile(df, "ts", keys).finer is None) == (most > 4)
    assert (sorted_rows(placed()), sorted_rows(rolled())) == plain


def test_a_hot_time_is_split(spark, frame, monkeypatch):
    df = frame(awkward(2000), SCHEMA)
    monkeypatch.setattr(ordered, "PLAIN_ROWS", 0)
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 100)
    sizes = ordered._with_bucket(df, "ts", ordered.profile(df, "ts")).groupBy("__b").count().toPandas()["count"]
    assert sizes.max() < 300 and len(sizes) > 12


@pytest.mark.parametrize("kind", ["double", "decimal(10,2)", "int", "date"])
def test_order_of_other_types(spark, frame, path, kind):
    if kind == "date":
        value = F.expr("date_add(date'2000-01-01', cast(value as int))")
    else:
        value = F.col("value").cast(kind)
    df = frame(series(90, fn=lambda i: None if i == 7 else (i * 37 % 90) / (4 if kind in ("double", "decimal(10,2)") else 1))).select(value.alias("o"))
    if kind == "double":
        df = df.unionAll(spark.sql("select explode(array(double('nan'), double('-infinity'), double('infinity')))"))
    got = ordered.with_position(df, "o").orderBy("pos").toPandas()["o"]
    want = df.orderBy(F.col("o").asc_nulls_first()).toPandas()["o"]
    known = [x for x in want if x is not None and x == x and abs(x if kind != "date" else 0) != float("inf")]
    assert [x for x in got if x is not None and x == x and abs(x if kind != "date" else 0) != float("inf")] == known
