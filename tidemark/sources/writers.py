"""Sinks: flavours of the frequency tables, Parquet folder to CSV, fitted models."""

from __future__ import annotations

import posixpath
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.time import HOUR_FORMAT
from .readers import frequency_path


def write_table(df: DataFrame, path: str, fmt: str = "csv", time_format: str | None = None) -> None:
    """Write a table; ``time_format`` is the text form of times in CSV (by default ISO with all digits)."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        if time_format:
            writer = writer.option("timestampFormat", time_format).option("timestampNTZFormat", time_format)
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_flavours(df: DataFrame, base: str, freq: str, time_col: str = "Start", fmt: str = "csv") -> dict[str, str]:
    """The datetime table (with the time column) and the timestamp table (without it)."""
    if not isinstance(base, str):
        raise TypeError("base must be a path")
    paths = {flavour: frequency_path(base, freq, flavour) for flavour in ("datetime", "timestamp")}
    write_table(df, paths["datetime"], fmt, HOUR_FORMAT)
    write_table(df.drop(time_col), paths["timestamp"], fmt, HOUR_FORMAT)
    return paths


def write_frequencies(tables: dict[str, DataFrame], base: str, time_col: str = "Start", fmt: str = "csv") -> None:
    """Both flavours of every frequency; the hourly table is read once for all of them if the caller cached it."""
    for freq, df in tables.items():
        write_flavours(df, base, freq, time_col, fmt)


def list_parquet(spark: SparkSession, folder: str) -> list[str]:
    """Every ``*.parquet`` entry directly below a folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(posixpath.join(folder, "*.parquet"))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(s.getPath().toString()) for s in fs.globStatus(path) or [])


CONVERSION_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def convert_parquet_to_csv(spark: SparkSession, input_folder: str, output_folder: str, parallelism: int = 8) -> DataFrame:
    """Write every Parquet table of a folder as CSV under the same name.

    A table that fails is reported in ``error`` and does not stop the others.
    """

    def convert(source: str):
        name = posixpath.basename(source)[: -len(".parquet")]
        target = posixpath.join(output_folder, f"{name}.csv")
        try:
            write_table(spark.read.parquet(source), target)
            return source, target, None
        except Exception as problem:  # one broken file must not stop the rest
            return source, target, str(problem).splitlines()[0]

    sources = list_parquet(spark, input_folder)
    if not sources:
        return spark.createDataFrame([], CONVERSION_SCHEMA)
    with ThreadPool(min(parallelism, len(sources))) as pool:
        rows = pool.map(convert, sources)
    return spark.createDataFrame(rows, CONVERSION_SCHEMA)
