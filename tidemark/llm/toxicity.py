"""Operator 6: toxicity by boosted trees over dense features, calibrated by isotonic regression.

Three disjoint parts of the labelled rows teach three things: which words and word
beginnings mark toxic texts, the trees over the features below, and the calibration.
Each part is a bounded sample, the rows with the smallest hashes of their id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, stored

LEXICON_ROWS = 12_000
TREE_ROWS = 12_000
CALIBRATION_ROWS = 8_000
LEXICON_TERMS = 5_000
TREES, DEPTH, RATE = 20, 4, 0.2
THRESHOLD = 0.7
PREFIXES = range(3, 9)
CACHE_WORDS = 400_000
# Common insults, and second-person words of four languages.
INSULTS = "idiot moron stupid loser pathetic worthless disgusting scum trash clown dumb ugly filthy hateful".split()
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu toi te ton tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split()
)
LEET = str.maketrans("013457@$!|", "oieastasii")
FEATURES = [
    "words", "hits", "hit_density", "strongest", "weight", "weight_density", "kinds", "insult_density", "you_density",
    "you_near", "capitals", "shouted", "exclamations", "punctuation", "obfuscated", "obfuscated_hits",
]


@dataclass
class Model:
    """What fitting leaves: a bounded lexicon, trees and a calibration (None without both classes)."""

    lexicon: dict[str, float]
    trees: object
    calibration: object
    base: float


def term_weights(labelled: DataFrame) -> dict[str, float]:
    """Words (ending in ``$``) and word beginnings that mark toxic rows, with weights.

    The weight is the lower end of a 95 % interval of the log odds ratio, counted once per
    text. The LEXICON_TERMS heaviest are kept.
    """
    lower = F.lower("text")
    words = F.array_distinct(F.split(lower, r"[^\p{L}\p{N}]+"))
    of_text = labelled.where("text is not null").select("toxic", F.monotonically_increasing_id().alias("row"), F.explode(words).alias("word")).where("word <> ''")
    starts = F.transform(F.sequence(F.lit(PREFIXES[0]), F.least(F.length("word") - 1, F.lit(PREFIXES[-1]))), lambda n: F.substring("word", F.lit(1), n))
    terms = F.when(F.length("word") > PREFIXES[0], F.concat(starts, F.array(F.concat("word", F.lit("$"))))).otherwise(F.array(F.concat("word", F.lit("$"))))
    each = of_text.select("toxic", "row", F.explode(terms).alias("term")).distinct()
    size = labelled.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = float(size["t"] or 0), float(size["n"] - (size["t"] or 0))
    if not toxic or not clean:
        return {}
    counts = each.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a >= 3")
    odds = F.log((F.col("a") + 0.5) / (toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (clean - F.col("b") + 0.5))
    weight = odds - 1.64 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    found = counts.select("term", weight.alias("weight")).where("weight >= 1.5").orderBy(F.desc("weight"), "term").limit(LEXICON_TERMS)
    return {r["term"]: r["weight"] for r in found.collect()}


_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\W\d_](?:[\d@$!|]|[.\-_*]+)[^\W\d_]")


class _Codes(dict):
    """One byte per blank-separated word: 0 nothing, 1 second person, 2 disguised, from 3 a term.

    3 to 127 are terms by weight, 128 more when the word was disguised.
    """

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.you, self.insults = lexicon, set(SECOND_PERSON), set(INSULTS)

    def weight(self, word: str) -> float:
        lexicon = self.lexicon
        best = lexicon.get(word + "$", 0.0)
        for n in PREFIXES:
            if n >= len(word):
                break
            best = max(best, lexicon.get(word[:n], 0.0))
        return max(best, 4.0) if word in self.insults else best

    def code(self, token: str) -> int:
        word = token if token.isalpha() else _EDGE.sub("", token)
        weight, hidden = self.weight(word), 0
        if not word.isalpha() and _INNER.search(word):
            plain = re.sub(r"[\W\d_]", "", word.translate(LEET))
            hidden, weight = 128, max(weight, self.weight(plain))
            if not weight:
                return 2
        if weight:
            return hidden + 3 + min(124, int(weight * 10))
        return 1 if word in self.you else 0

    def __missing__(self, token: str) -> int:
        value = self.code(token)
        if len(self) < CACHE_WORDS and len(token) <= 64:
            self[token] = value
        return value


def features(text: str | None, codes: _Codes) -> list[float]:
    """The FEATURES of one text; zeros for a null or blank one."""
    import numpy as np

    lower = (text or "").lower()
    tokens = lower.split()
    if not tokens:
        return [0.0] * len(FEATURES)
    n = len(tokens)
    seen = np.frombuffer(bytes(map(codes.__getitem__, tokens)), np.uint8)
    places = np.flatnonzero(seen)
    marks = seen[places]
    hit = (marks & 127) >= 3
    hits, you = places[hit], places[marks == 1]
    weights = ((marks[hit] & 127) - 3) / 10.0
    near = 0.0
    if len(hits) and len(you):
        at = np.searchsorted(you, hits)
        before, after = np.abs(hits - you[np.maximum(at - 1, 0)]), np.abs(you[np.minimum(at, len(you) - 1)] - hits)
        near = 1.0 / (1.0 + float(np.minimum(before, after).min()))
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    upper = (raw >= 65) & (raw <= 90)
    letters = max(1, int(upper.sum() + ((raw >= 97) & (raw <= 122)).sum()))
    marked = ((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126))
    return [
        float(np.log1p(n)),
        float(np.log1p(len(hits))),
        len(hits) / n,
        float(weights.max()) if len(weights) else 0.0,
        float(np.log1p(weights.sum())),
        float(weights.sum()) / n,
        float(len({tokens[i] for i in hits})),
        sum(tokens[i].strip(".,!?;:") in codes.insults for i in hits) / n,
        len(you) / n,
        near,
        float(upper.sum()) / letters,
        float((upper[1:] & upper[:-1]).sum()) / letters,
        float((raw == 33).sum()) / n,
        float(marked.sum()) / len(raw),
        float((marks == 2).sum() + (marks >= 128).sum()) / n,
        float(np.log1p((marks[hit] >= 128).sum())),
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """Adds ``features`` to rows with key and text (and label, if there is one)."""
    small_batches(docs.sparkSession)
    names = [c for c in ("key", "toxic") if c in docs.columns]
    source = docs.select(*names, "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codes = _Codes(lexicon)
        for batch in batches:
            rows = [features(t.as_py(), codes) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(rows, pa.list_(pa.float64()))], [*names, "features"])

    schema = ", ".join([*(f"{c} {source.schema[c].dataType.simpleString()}" for c in names), "features array<double>"])
    return source.mapInArrow(run, schema)


def _vectors(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector("features"))


def remainder(id_column):
    """crc32 of the id as text, modulo 3: 1 marks held-out rows."""
    return F.crc32(id_column.cast("string")) % 3


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled documents whose remainder is not 1.

    Rows without a document, with a null id or with a null label teach nothing; the label of
    an id that is listed more than once is its largest.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import IsotonicRegression

    order = F.xxhash64("key")
    known = labels.select(labels["doc_id"].alias("key"), labels["toxic"].cast("int").alias("toxic")).where("key is not null and toxic is not null").groupBy("key").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("part", remainder(F.col("key")))
    third = F.pmod(F.xxhash64(F.col("key"), F.lit(7)), F.lit(5)) < 3
    samples = {
        "lexicon": (known.where("part = 0"), LEXICON_ROWS),
        "trees": (known.where("part = 2").where(third), TREE_ROWS),
        "calibration": (known.where("part = 2").where(~third), CALIBRATION_ROWS),
    }
    picked = None
    for use, (rows, bound) in samples.items():
        some = rows.orderBy(order, "key").limit(bound).select("key", "toxic", F.lit(use).alias("use"))
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(docs["doc_id"].alias("key"), docs["text"].alias("text"))
    # At most LEXICON_ROWS + TREE_ROWS + CALIBRATION_ROWS ids: safe to send everywhere.
    rows = stored(texts.join(F.broadcast(picked), "key"), "labelled")
    lexicon = term_weights(rows.where("use = 'lexicon'"))
    learn = {use: stored(with_features(rows.where(F.col("use") == use), lexicon).coalesce(4), "features") for use in ("trees", "calibration")}
    share = rows.agg(F.avg("toxic")).first()[0]
    seen = {use: df.select("toxic").distinct().count() for use, df in learn.items()}
    if min(seen.values()) < 2:
        return Model(lexicon, None, None, float(share or 0.0))
    gbt = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, maxBins=64, seed=7, cacheNodeIds=False)
    trees = gbt.fit(_vectors(learn["trees"]))
    scored = _raw(trees, learn["calibration"]).select("raw", F.col("toxic").cast("double").alias("toxic"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="toxic").fit(scored)
    return Model(lexicon, trees, calibration, float(share))


def _raw(trees, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return trees.transform(_vectors(df)).withColumn("raw", vector_to_array("probability")[1]).drop("prediction", "rawPrediction", "probability", "features")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from the text alone.

    Null and empty texts get the score of a text without any mark. Without labels of both
    classes every score is the share of toxic labels. Repeated rows get equal scores.
    """
    rows = with_features(docs.select(docs["doc_id"].alias("key"), docs["text"].alias("text")), model.lexicon)
    if model.trees is None:
        scored = rows.withColumn("score", F.lit(model.base))
    else:
        scored = model.calibration.transform(_raw(model.trees, rows)).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "prediction")))
    return scored.select(
        F.col("key").alias("doc_id"),
        F.coalesce(remainder(F.col("key")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels and score every document."""
    return score(docs, fit(docs, labels))
