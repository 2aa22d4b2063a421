"""Rows of a column are never gathered in one task to meet its brackets."""

import re

from pyspark.sql import functions as F

from tidemark.operators import quantiles


def test_brackets_go_to_the_rows(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SKETCH", 100)
    plans, real = [], quantiles.cut_lineage
    monkeypatch.setattr(quantiles, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(5000).select((F.col("id") * 7 % 5000).cast("double").alias("value"))
        got = quantiles.grouped_quantiles(rows, ["value"], [0.25, 0.5], group_rows=10).first()["value"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [1249.75, 2499.5]
    assert any("BroadcastHashJoin" in p for p in plans) and not any(re.search("SortMergeJoin|ShuffledHashJoin", p) for p in plans[:2])
