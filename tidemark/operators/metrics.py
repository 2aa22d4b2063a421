"""Forecast scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ordered import Profile, place

# Fixed value: smallest denominator of the percentage error (machine epsilon of a double).
EPSILON = 2.220446049250313e-16


def error_columns(actual: str = "actual", predicted: str = "predicted") -> dict[str, Column]:
    """Aggregates MAE, MSE, RMSE, MAPE (a fraction) and Bias."""
    y, p = F.col(actual), F.col(predicted)
    miss = F.abs(y - p)
    return {
        "MAE": F.avg(miss),
        "MSE": F.avg((y - p) * (y - p)),
        "RMSE": F.sqrt(F.avg((y - p) * (y - p))),
        "MAPE": F.avg(miss / F.greatest(F.abs(y), F.lit(EPSILON))),
        "Bias": F.avg(p - y),
    }


def error_metrics(
    df: DataFrame,
    actual: str = "actual",
    predicted: str = "predicted",
    by: Sequence[str] = (),
    swap: bool = False,
) -> DataFrame:
    """One row of scores per group; ``swap=True`` exchanges the roles of the two columns."""
    if swap:
        actual, predicted = predicted, actual
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in error_columns(actual, predicted).items()])


def score(
    df: DataFrame,
    time_col: str,
    actual: str = "actual",
    predicted: str = "predicted",
    by: Sequence[str] = (),
    prof: Profile | None = None,
) -> DataFrame:
    """Error metrics and MASE of every group in one aggregate.

    MASE divides the MAE by the MAE of the previous actual value, over rows 2..n of
    the same evaluated rows; a flat series gives null.
    """
    previous = place(df, time_col, by, before={"__prev": actual}, prof=prof)
    aggs = error_columns(actual, predicted)
    naive = F.avg(F.abs(F.col(actual) - F.col("__prev")))
    aggs["MASE"] = F.try_divide(aggs["MAE"], naive)
    return previous.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])


def mase(
    df: DataFrame,
    time_col: str,
    actual: str = "actual",
    predicted: str = "predicted",
    by: Sequence[str] = (),
    prof: Profile | None = None,
) -> DataFrame:
    """Mean absolute scaled error of every group."""
    return score(df, time_col, actual, predicted, by, prof).select(*by, "MASE")


def actual_vs_predicted(
    actuals: DataFrame,
    predictions: DataFrame,
    time_col: str,
    actual: str = "actual",
    predicted: str = "predicted",
    keys: Sequence[str] = (),
    name: str | None = None,
) -> DataFrame:
    """Predictions joined to actuals on time (and keys); a row without its counterpart is an error."""
    left = actuals.select(F.struct(*keys, time_col).alias("__a"), F.lit(True).alias("__has_a"), F.col(actual).alias("actual"))
    right = predictions.select(
        F.struct(*keys, time_col).alias("__p"), F.lit(True).alias("__has_p"), F.col(predicted).alias("predicted")
    )
    joined = left.join(right, F.col("__a") == F.col("__p"), "full_outer")
    unmatched = F.col("__has_a").isNull() | F.col("__has_p").isNull()
    # The check guards the value itself, so that no plan can leave it out.
    checked = F.when(unmatched, F.raise_error(F.lit("actuals and predictions do not match"))).otherwise(F.col("predicted"))
    cols = [F.col(f"__a.{c}").alias(c) for c in [*keys, time_col]]
    cols += [F.col("actual"), checked.cast("double").alias("predicted")]
    if name is not None:
        cols.append(F.lit(name).alias("name"))
    return joined.select(*cols)


def compare_models(scores: DataFrame, metric: str = "MAE", by: Sequence[str] = ("freq", "split")) -> DataFrame:
    """Rank of each model within frequency and split; rank 1 is the best."""
    order = Window.partitionBy(*by).orderBy(F.col(metric).asc_nulls_last(), F.col("model"))
    return scores.withColumn("rank", F.row_number().over(order).cast("bigint"))
