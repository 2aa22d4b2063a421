"""Sources: pollutant files, the H/D/W/M family, single tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FREQUENCIES, RAW_SCHEMA, frequency_schema


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def require_paths(spark: SparkSession, paths: Sequence[str]) -> None:
    """One clear error that names every missing input."""
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing input: {', '.join(missing)}")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table, or a CSV table with header and explicit schema."""
    require_paths(spark, [path])
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_pollutants(
    spark: SparkSession,
    paths: Mapping[str, str],
    schema: T.StructType = RAW_SCHEMA,
) -> dict[str, DataFrame]:
    """One raw table per pollutant, in the order of ``paths``."""
    require_paths(spark, list(paths.values()))
    return {name: read_table(spark, path, schema) for name, path in paths.items()}


def stack_pollutants(tables: Mapping[str, DataFrame], name: str = "pollutant_name") -> DataFrame:
    """Long form of the raw tables with the pollutant as a column."""
    tagged = [df.withColumn(name, F.lit(key)) for key, df in tables.items()]
    return reduce(DataFrame.unionByName, tagged)


def frequency_path(base: str, freq: str, flavour: str) -> str:
    """Folder of one table below ``base``; Spark prunes by ``freq`` when the family is read as a whole."""
    return f"{base}/{flavour}/freq={freq}"


def read_frequencies(
    spark: SparkSession,
    base: str | Mapping[str, str],
    flavour: str = "datetime",
    fmt: str = "csv",
    schemas: Mapping[str, T.StructType] | None = None,
) -> dict[str, DataFrame]:
    """The hourly, daily, weekly and monthly tables of one flavour."""
    paths = base if isinstance(base, Mapping) else {f: frequency_path(base, f, flavour) for f in FREQUENCIES}
    require_paths(spark, list(paths.values()))
    if fmt == "parquet":
        return {f: spark.read.parquet(p) for f, p in paths.items()}
    schemas = schemas or {f: frequency_schema(f, flavour) for f in paths}
    return {f: read_table(spark, p, schemas[f]) for f, p in paths.items()}
