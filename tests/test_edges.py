"""Empty tables, single rows, constant and all-null columns through every operator."""

import pytest

from conftest import series
from tidemark.operators import clean, metrics, ordered, resample, scale, sequence, split, stats, timestats

OPERATORS = {
    "position": lambda df: ordered.with_position(df, "ts", total="n"),
    "sentinel": lambda df: clean.sentinel_to_null(df),
    "impute": lambda df: clean.impute_missing(df, ["value"]),
    "outliers": lambda df: clean.iqr_outliers(df, "value"),
    "share": lambda df: clean.outlier_share(df, "value"),
    "day": lambda df: resample.resample_median(df, "ts", "D"),
    "month": lambda df: resample.resample_median(df, "ts", "M"),
    "grid": lambda df: resample.as_frequency(df, "ts", "H"),
    "describe": lambda df: stats.describe(df, ["value"]),
    "skewness": lambda df: stats.skewness(df, "value"),
    "correlation": lambda df: stats.correlation_matrix(df, ["value"]),
    "histogram": lambda df: stats.histogram(df, ["value"]),
    "kde": lambda df: stats.kde(df, "value"),
    "box": lambda df: stats.box_stats(df, "value"),
    "rolling": lambda df: sequence.rolling_mean_std(df, "value", "ts"),
    "lag": lambda df: sequence.lag(df, "value", "ts", 3),
    "difference": lambda df: sequence.difference(df, "value", "ts"),
    "windows": lambda df: sequence.create_windows(df, ["value"], "ts", 4),
    "split": lambda df: split.chronological_split(df, "ts"),
    "folds": lambda df: split.time_series_folds(df, "ts"),
    "acf": lambda df: timestats.acf(df, "value", "ts", 3),
    "pacf": lambda df: timestats.pacf(df, "value", "ts", 3),
    "adf": lambda df: timestats.adf_test(df, "value", "ts"),
    "scale": lambda df: scale.standard_scale(df, ["value"], fit_on="all"),
    "score": lambda df: metrics.score(df, "ts", "value", "value"),
}
TABLES = {
    "empty": [],
    "one row": series(1),
    "constant": series(40, fn=lambda i: 5),
    "all null": series(40, fn=lambda i: None),
}


@pytest.mark.parametrize("table", TABLES)
def test_operators_survive(spark, frame, table):
    df = frame(TABLES[table])
    rows = {name: len(op(df).collect()) for name, op in OPERATORS.items()}
    n = len(TABLES[table])
    for same in ("position", "sentinel", "impute", "rolling", "lag", "split", "scale", "grid"):
        assert rows[same] == n, same
    assert rows["outliers"] == 0 and rows["adf"] <= 1


def test_hot_group_of_nulls_and_ties(spark, frame, path):
    """A third of the rows in one group, all with the same value or none."""
    rows = [("hot", t, None if i % 2 else 4.0) for i, (t, _) in enumerate(series(60))]
    rows += [(f"k{i % 30}", t, float(i)) for i, (t, _) in enumerate(series(120))]
    df = frame(rows, "k string, ts timestamp, value double")
    got = {r.k: r for r in stats.describe(df, ["value"], ["k"]).collect()}
    assert len(got) == 31 and (got["hot"].p25, got["hot"].p50, got["hot"]["count"]) == (4.0, 4.0, 30)
    assert got["k3"].p50 == 48.0
