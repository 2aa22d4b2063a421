"""Helpers of the operators in this package: tables in the shared folder, files, components."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path

BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Few rows per Arrow batch: a batch of very long texts must fit a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """The frame as a table in the shared folder: computed once, whatever executor is lost later."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def file_system(folder: str):
    """File system and path of a folder named by URI or plain path, for tasks and the driver."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder[5:])
    return fs.LocalFileSystem(), folder


def commit(fs, folder: str, name: str, chunks) -> int:
    """Write a file under a temporary name and rename it; bytes written.

    Attempts of one task write different temporary files with equal content, so the last
    rename changes nothing that a reader could have seen.
    """
    hidden = posixpath.join(folder, f"_{name}.{uuid.uuid4().hex}")
    written = 0
    with fs.open_output_stream(hidden) as out:
        for chunk in chunks:
            out.write(chunk)
            written += len(chunk)
    fs.move(hidden, posixpath.join(folder, name))
    return written


def small_enough(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> bool:
    """Is the frame proven to hold at most ``limit`` bytes, at ``row_bytes`` each?"""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges`` has columns a and b of one sortable type. Returns node and component, the
    smallest node reachable, for every node that has an edge to another node. Each round
    is two joins on a node with the minimum of its neighbours; no list of neighbours is
    ever built. The minima are stored, so that each join has shuffles of its own and AQE
    splits the partition of a node with very many neighbours.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "minima")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "edges")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")
        now = stored(small.distinct(), "edges")
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
