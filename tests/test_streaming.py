import numpy as np
import pandas as pd
import pytest

from conftest import series
from tidemark.operators.clean import sentinel_to_null
from tidemark.operators.resample import resample_median
from tidemark.session import new_path
from tidemark.streaming.ingest import clean_stream, median_stream


def run(spark, stream, path):
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append")
        .trigger(availableNow=True).start(f"{path}/out")
    )
    query.awaitTermination(120)
    return spark.read.parquet(f"{path}/out")


@pytest.mark.parametrize("freq", ["D", "W"])
def test_stream_equals_batch(spark, frame, freq):
    rows = series(24 * 40, fn=lambda i: -999 if i % 31 == 0 else np.cos(i))
    source = new_path(spark, "stream")
    # Files arrive in time order; the second repeats some readings of the first.
    frame(rows[:600]).coalesce(1).write.parquet(f"{source}/a")
    frame(rows[590:]).coalesce(1).write.parquet(f"{source}/b")
    stream = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    made = median_stream(clean_stream(stream, "ts", ["value"]), "ts", freq, ["value"])
    got = run(spark, made, new_path(spark, "sink")).orderBy("ts").toPandas()
    want = resample_median(sentinel_to_null(frame(rows)), "ts", freq, ["value"]).orderBy("ts").toPandas()
    # The last bins stay open until the watermark passes them.
    assert 0 < len(want) - len(got) <= 3
    both = pd.merge(got, want, on="ts", suffixes=("", "_batch"))
    assert len(both) == len(got)
    assert np.allclose(both.value, both.value_batch) and (both.ts_Timestamp == both.ts_Timestamp_batch).all()


def test_months_are_refused(spark, frame):
    with pytest.raises(ValueError):
        median_stream(frame([]), "ts", "M", ["value"])
