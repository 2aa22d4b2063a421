"""The previous value as forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import drop_null_rows
from ..operators.metrics import score
from ..operators.ordered import place
from ..operators.split import chronological_split
from ..schema import TARGET


def naive_predictions(df: DataFrame, time_col: str, target: str = TARGET, keys=()) -> DataFrame:
    """``keys…, time, actual, predicted, pos, split``: previous value, incomplete rows dropped, then split."""
    actual = df.select(*keys, time_col, F.col(target).cast("double").alias("actual"))
    shifted = drop_null_rows(place(actual, time_col, keys, before={"predicted": "actual"}), ["actual", "predicted"])
    return chronological_split(shifted, time_col, keys=keys)


def naive_forecast(df: DataFrame, time_col: str, freq: str, target: str = TARGET, keys=()) -> DataFrame:
    """Scores of the naive forecast on validation and test."""
    rows = naive_predictions(df, time_col, target, keys).filter(F.col("split") != "train")
    named = rows.withColumns({"model": F.lit("naive"), "freq": F.lit(freq)})
    return score(named, time_col, by=[*keys, "model", "freq", "split"])
