"""A network search reads its table once."""

from pyspark.sql import functions as F

from tidemark import tuning


def test_search_stores_its_table_before_all_passes(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        read.add(1)
        return float(v)

    rows = spark.range(80).select(F.timestamp_seconds(F.col("id") * 86400).alias("ts"), seen((F.col("id") % 7).cast("double")).alias("v"))
    monkeypatch.setattr(tuning, "fit_network", lambda train, held, net, rate, epochs, seed: (None, [float(train.count() + net.units[0])]))
    found = tuning.nn_search(rows, "dnn", "D", "ts", channels=["v"], window=4, trials=3)
    assert [r["trial"] for r in found.collect()] and found.count() == 3
    assert read.value == 80
