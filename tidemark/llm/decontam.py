"""Operator 10: benchmark decontamination by a prefix-filtered set join, native.

A window is 13 consecutive words of an item. To contain a window a text must hold all of
its words, so one of them suffices as the window's prefix: the rarest over the whole
corpus. Words of documents meet prefixes in a join, bounds on length and position drop
what cannot fit, and the rest is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_enough, stored

WINDOW = 13
SHARE = 20
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROBE_BYTES = 256


def exact_words(text: Column) -> Column:
    """Words of a text with A-Z in lower case and no other letter changed."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), "")


def folded(text: Column) -> Column:
    """All letters in lower case, which is fast; texts equal but for A-Z stay equal.

    The one letter whose lower case depends on its neighbours is replaced beforehand.
    """
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def folded_words(text: Column) -> Column:
    """As many words as ``exact_words``, in all letters' lower case: for finding candidates."""
    return F.array_remove(F.split(folded(F.coalesce(text, F.lit(""))), BREAKS), "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, window as words) of all items, each pair once; items without words have none."""
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item"), exact_words(benchmark["text"]).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("w")).distinct()


def _near(df: DataFrame, row_bytes: int) -> DataFrame:
    """The frame marked for broadcast if its size is proven to be small."""
    return F.broadcast(df) if small_enough(df, row_bytes) else df


def prefixes(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(word, at, size, item, w): for every window its rarest word and that word's place in it."""
    placed = found.select("item", "w", F.posexplode(F.transform("w", folded)).alias("at", "word"))
    known = _near(stored(placed.select("word").distinct(), "item-words"), 64)
    counts = docs.select(F.explode("words").alias("word")).join(known, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    ranked = placed.join(stored(counts, "item-word-counts"), "word", "left")
    first = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("p")
    return ranked.groupBy("item", "w").agg(first).select("p.word", "p.at", F.size("w").alias("size"), "item", "w")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document row.

    A word is hit if it lies in an occurrence of any window; a document is contaminated if
    at least one word in SHARE is hit. Null and empty texts have no words and are clean.
    Null item ids are left out of the item list. Repeated rows are judged one by one;
    an empty benchmark leaves all clean. Other columns do not take part.
    """
    source = docs.select(docs["doc_id"].alias("doc"), docs["text"].alias("body"))
    probes = stored(prefixes(windows(benchmark, size), source.select(folded_words(F.col("body")).alias("words"))), "windows")
    words = source.select("doc", folded_words(F.col("body")).alias("words")).select("doc", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    begin = F.col("pos") - F.col("at")
    met = words.join(_near(probes, PROBE_BYTES), "word").where((begin >= 0) & (begin + F.col("size") <= F.col("n")))
    candidates = stored(met.select("doc", begin.alias("begin"), "size", "item", "w").distinct(), "candidates")
    by_doc = candidates.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("begin", "size", "item", "w")).alias("found"))
    by_doc = F.broadcast(by_doc) if small_enough(candidates, PROBE_BYTES) else by_doc
    joined = source.join(by_doc, F.col("doc").eqNullSafe(F.col("of")), "left")
    # The generator keeps the words from being split again for every candidate.
    split = F.when(F.col("found").isNull(), folded_words(F.col("body"))).otherwise(exact_words(F.col("body")))
    rows = joined.select("doc", "found", F.explode(F.array(split)).alias("words"))
    same = F.filter("found", lambda c: F.slice("words", c["begin"] + 1, c["size"]) == c["w"])
    rows = rows.select("doc", F.size("words").cast("bigint").alias("n_words"), F.explode(F.array(F.coalesce(same, F.array()))).alias("hits"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c["begin"], c["begin"] + c["size"] - 1))))
    items = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda c: c["item"]), lambda i: i.isNotNull())))
    rows = rows.select("doc", "n_words", F.size(covered).cast("bigint").alias("n_hit"), items.alias("items"))
    return rows.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
