"""Toxicity, decontamination and the pipeline."""

import hashlib
import re
import zlib

import pytest
from odd import by_id, odd_documents
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontam, simhash, toxicity
from tidemark.llm.shared import table

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_decontamination(rows, items):
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            grams.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for key, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                if same := grams.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= same
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, "Éa ΑΣ short"), (3, None), (10, " ".join(f"w{i}" for i in range(5, 20))), (4, "..."), (5, "a a a a"), (5, "the end")]
    texts = [
        long.upper(), "x " * 700 + " ".join(f"W{i}" for i in range(3, 20)), "Éa, ασ short", "Éa ΑΣ-short;", "éa ΑΣ short", "a a a a a a b a a a", "the\nEND",
        " ".join(f"w{i}" for i in range(12)), "w1 " * 50, long + " " + long,
    ]
    rows, docs = odd_documents(spark, texts)
    bench = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id bigint, text string, w string, n int")
    got = sorted((tuple(r) for r in decontam.decontaminate(docs, bench).collect()), key=repr)
    assert got == sorted(slow_decontamination(rows, items), key=repr)
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    return toxicity.toxicity(docs, labels).join(labels, "doc_id", "left").toPandas(), docs.count()


def test_scores_are_whole_and_held_out_rows_do_well(scored):
    got, n = scored
    assert len(got) == n and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    known = got[got["held_out"] & got["toxic"].notna()]
    toxic, clean = known[known["toxic"] == 1]["score"], known[known["toxic"] == 0]["score"]
    above = sum((t > clean).sum() + 0.5 * (t == clean).sum() for t in toxic) / (len(toxic) * len(clean))
    assert above > 0.85
    assert (known[known["predicted"] == 1]["toxic"] == 1).mean() > 0.8


def test_held_out_labels_teach_nothing(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = toxicity.remainder(F.col("doc_id")) == 1
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fit(docs, x) for x in (labels, turned))
    assert one.lexicon == two.lexicon and one.trees.toDebugString.split("\n", 1)[1] == two.trees.toDebugString.split("\n", 1)[1]


def test_odd_rows_have_scores(spark):
    rows, docs = odd_documents(spark, ["you idiot", "1d10t", "a" * 100_000])
    labels = spark.createDataFrame([(0, 1), (None, 1), (5000, 1), (2, None)], "doc_id bigint, toxic int")
    got = by_id(toxicity.toxicity(docs, labels).collect())
    assert sum(map(len, got.values())) == len(rows) and all(0 <= r["score"] <= 1 for x in got.values() for r in x)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_features_see_disguise_and_address():
    codes = toxicity._Codes({"idiot$": 5.0, "lowei": 3.0})
    at = dict(zip(toxicity.FEATURES, toxicity.features("YOU are an 1d1ot! and loweiton, i.d.i.o.t.", codes)))
    assert at["kinds"] == 3 and at["strongest"] == 5.0 and at["you_near"] > 0.2 and at["obfuscated_hits"] > 0 and at["shouted"] > 0
    assert toxicity.features(None, codes) == toxicity.features("  ", codes) == [0.0] * len(toxicity.FEATURES)


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns and 0.85 * len(before) < clean.count() < len(before)
    few = docs.where("doc_id < 300")
    single = corpus_pipeline.drop_near_copies(spark, few, SF).collect()
    parts = simhash.near_duplicates(few).select("component_id").distinct().count()
    assert len(single) == parts and all(before[r["doc_id"]] == r["text"] for r in single)
    lined = corpus_pipeline.drop_repeated_lines(spark, few, SF)
    assert lined.columns == docs.columns and lined.count() == few.count()
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    bad = {x[0] for x in slow_decontamination(list(before.items()), items) if x[5]}
    assert {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()} == set(before) - bad


def test_pipeline_of_odd_documents(spark):
    _, docs = odd_documents(spark, ["some text that says nothing bad"] * 3)
    docs = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(1).cast("bigint")})
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, "/root/testdata/sf0.001").collect(), stage(spark, docs.limit(0), "/root/testdata/sf0.001").schema)
    assert 0 < docs.count() < 10


def test_pipeline_keeps_rows_that_repeat_an_id(spark):
    """Rows are judged by what they are: an id shared with, or missing in, a bad row takes no good row along."""
    item = table(spark, "/root/testdata/sf0.001", "benchmark").where("text is not null").first()["text"]
    clean = [" ".join(f"{w}{i}" for i in range(60)) for w in ("maple", "otter", "cedar", "heron")]
    line = "the very same long line in two documents"
    rows = [(1, clean[0]), (1, clean[1]), (1, item), (None, clean[2]), (None, item), (2, line + "\nmore of a"), (2, "first of b\n" + line), (3, clean[3]), (3, clean[3]), (None, clean[3])]
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    seen = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    sf = "/root/testdata/sf0.001"
    assert seen(corpus_pipeline.drop_contaminated(spark, docs, sf)) == sorted((r for r in rows if r[1] != item), key=repr)
    lined = seen(corpus_pipeline.drop_repeated_lines(spark, docs, sf))
    assert len(lined) == len(rows)
    two = [t for i, t in lined if i == 2]
    assert sum(line in t for t in two) == 1 and any("more of a" in t for t in two) and any("first of b" in t for t in two)
    single = seen(corpus_pipeline.drop_near_copies(spark, docs, sf))
    assert [i for i, t in single if t == clean[3]] == [3] and {t for _, t in single} >= {*clean, item} and len(single) == len({t for _, t in single})
    assert {t for _, t in seen(corpus_pipeline.drop_toxic(spark, docs, sf))} >= set(clean)
