"""The corpus pipeline: raw documents to encoded ones, each stage over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, lines, simhash, toxicity
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.shared import small_enough, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Share of its characters that may differ in a line beside the one edit that any line may have.
LINE_SHARE = 0.01


def _digest() -> Column:
    """What a document is known by where its text alone decides: repeated ids may have different texts."""
    return F.xxhash64("doc_id", "text")


def _identity() -> Column:
    """What a document is known by where documents are ordered: by id, null ids last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"))


def _without(docs: DataFrame, key: Column, gone: DataFrame, label: str) -> DataFrame:
    """The documents whose key is none of the ``doc_id`` in ``gone``; these are broadcast only if proven few.

    Rows that repeat an id and a text share a key and go or stay together; rows that
    repeat an id with different texts, or have none, are judged one by one.
    """
    gone = stored(gone.select(F.col("doc_id").alias("gone")).distinct(), label)
    gone = F.broadcast(gone) if small_enough(gone, 64) else gone
    return docs.withColumn("key", key).join(gone, F.col("key") == F.col("gone"), "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels, does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumn("doc_id", _digest()), model)
    return _without(docs, _digest(), scored.where("predicted = 1"), "toxic")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that nearly repeat an earlier one; n_chars is counted anew."""
    kept = lines.without_repeats(docs.select(*COLUMNS).withColumn("key", _identity()), "key", share=LINE_SHARE)
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document by (id, text digest) of each SimHash component, null ids last; of rows that repeat id and text one."""
    near = simhash.near_duplicates(docs.withColumn("doc_id", _identity()))
    kept = _without(docs, _identity(), near.where("doc_id <> component_id"), "near-copies")
    named = docs.select(_identity().alias("key"))
    if named.groupBy("key").count().where("count > 1").isEmpty():
        return kept
    one = kept.groupBy(_identity().alias("key")).agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return one.select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves clean."""
    judged = decontam.decontaminate(docs.withColumn("doc_id", _digest()), table(spark, sf_dir, "benchmark"))
    return _without(docs, _digest(), judged.where("contaminated"), "contaminated")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of every remaining document, and the check that decoding gives its text."""
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

ORACLE_SQL = None  # no SQL for fitted trees, XXH64 fingerprints and BPE: tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
