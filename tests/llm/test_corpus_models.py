"""Whitening, the quality network and collocations."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from odd import by_id, odd_documents
from pyspark.sql import functions as F

from tidemark.llm import phrases, quality, whiten
from tidemark.llm.shared import table

SF = "/root/testdata/sf0.01"


def slow_whitening(vectors):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    z = np.array([[(n * c - s) / n for c, s in zip(r, sums)] for r in x])
    values, axes = np.linalg.eigh(z.T @ z / n)
    return n, [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x], z @ axes[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300)), values[::-1] / values.sum()


def test_whitening_equals_dense_eigenvectors(spark):
    source = table(spark, SF, "embeddings")
    got = whiten.whitened(source).toPandas()
    rows = source.toPandas()
    n, deviation, wanted, share = slow_whitening(rows["embedding"].map(lambda v: [float(c) for c in v]))
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows["vec_id"]].to_numpy()
    assert wide.shape == (n, 32) and (got["n"] == n).all()
    signs = np.sign((wide * wanted[:, :32]).sum(axis=0))
    assert np.abs(wide * signs - wanted[:, :32]).max() < 1e-9
    assert got.drop_duplicates("vec_id").set_index("vec_id")["deviation"].loc[rows["vec_id"]].tolist() == deviation
    assert np.allclose(got.groupby("component")["explained"].first(), share[:32], rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(0, 1 + 3 * (np.arange(4) == 1)).tolist()) for i in range(50)]
    rows = [*good, good[3], (None, [1.0, 2.0, 0.5, 0.1]), (60, None), (61, []), (62, [1.0, None, 2.0, 3.0]), (63, [1.0, float("nan"), 2.0, 3.0]), (64, [1.0, float("inf"), 2.0, 3.0]), (65, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, key string, x int").repartition(3)
    got = whiten.whitened(frame).collect()
    n, deviation, wanted, _ = slow_whitening([r[1] for r in rows[:52]])
    assert len(got) == 52 * 4 and {r["n"] for r in got} == {n} and {r["vec_id"] for r in got} == {*range(50), None}
    assert sorted(r["deviation"] for r in got) == sorted(4 * deviation)
    assert abs(sorted(abs(r["whitened"]) for r in got)[-1] - np.abs(wanted).max()) < 1e-9
    assert whiten.whitened(frame.limit(0)).count() == whiten.whitened(frame.where("vec_id = 5")).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id bigint, embedding array<double>")
    assert whiten.whitened(same).count() == 0
    # One direction only, huge entries, and a deviation beyond 64 bits.
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)] + [(9, [1e300, -1e300])], "vec_id bigint, embedding array<double>")
    assert {r["component"] for r in whiten.whitened(line.where("vec_id < 9")).collect()} == {1}
    assert {r["deviation"] for r in whiten.whitened(line).collect() if r["vec_id"] == 9} == {None}


@pytest.mark.parametrize("values", [1.3 ** -np.arange(150.0), np.r_[np.linspace(5, 4, 10), np.linspace(1, 0.9, 140)], np.r_[3, 3, 3, 2, 2, np.ones(145)], np.r_[5, 4, np.zeros(60)], np.ones(3)])
def test_jacobi_davidson_reaches_double_precision(values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((d, d)))[0]
    a = (q * values) @ q.T
    found, axes, residuals = whiten.jacobi_davidson(lambda b: (a + a.T) / 2 @ b, d, 32)
    assert np.abs(found - np.sort(values)[::-1][:32]).max() < 1e-13 * values.max()
    assert residuals.max() < 1e-13 * values.max() and np.abs(axes.T @ axes - np.eye(len(found))).max() < 1e-13


def test_minres_solves_shifted_equations():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((12, 12))
    a, rhs, shifts = a + a.T, rng.standard_normal((12, 3)), np.array([0.1, -0.5, 7.0])
    got = whiten.minres(lambda b: a @ b, shifts, lambda t: t, rhs, 60, 1e-12)
    assert all(np.allclose((a - s * np.eye(12)) @ got[:, i], rhs[:, i], atol=1e-7) for i, s in enumerate(shifts))


def test_partial_sums_meet_in_fixed_order(spark, monkeypatch):
    monkeypatch.setattr(whiten, "PARTIALS", 2)
    rows = spark.createDataFrame([([i, 3 * i],) for i in range(100)], "x array<bigint>").repartition(7)
    m = whiten.moments(rows, 2)
    assert (m.n, m.sums) == (100, [4950, 14850])
    got = whiten.product(rows, m)(np.eye(2))
    assert np.allclose(got, np.cov(np.array([[i, 3 * i] for i in range(100)]).T, bias=True), rtol=1e-14)


@pytest.fixture(scope="module")
def graded(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    return quality.quality(docs, labels).join(labels, "doc_id", "left").toPandas(), docs.count()


def test_quality_of_held_out_rows(graded):
    got, n = graded
    assert len(got) == n and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    known = got[got["held_out"] & got["quality"].notna()]
    good, bad = known[known["quality"] == 1]["score"], known[known["quality"] == 0]["score"]
    assert sum((g > bad).sum() + 0.5 * (g == bad).sum() for g in good) / (len(good) * len(bad)) > 0.9
    assert (good >= 0.7).mean() > 0.9


def test_held_out_quality_teaches_nothing(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    held = quality.remainder(F.col("doc_id")) == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, turned)
    few = quality.labelled_sample(docs, labels, 10, 5_000).toPandas()
    assert 0 < len(few) <= 10 and few["text"].map(len).sum() <= 5_000


def test_quality_of_odd_rows(spark):
    rows, docs = odd_documents(spark, ["fine words here", "ALL!! CAPS!!", "x" * 100_000])
    labels = spark.createDataFrame([(0, 1), (1, 0), (900, 0), (903, 1), (None, 1), (5000, 1), (2, None)], "doc_id bigint, quality int")
    got = by_id(quality.quality(docs, labels).collect())
    assert sum(map(len, got.values())) == len(rows) and all(0 <= r["score"] <= 1 for x in got.values() for r in x)
    assert len({r["score"] for r in got[903]}) == 1 and got[900][0]["score"] == got[901][0]["score"]
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.quality(docs, labels.where("quality = 1")).collect()} == {1.0}


def slow_pool(net, text):
    """Every window of every chunk, one at a time."""
    s, w, c = quality.STRIDE, quality.WIDTH, quality.CHUNK
    windows = max(0, -(-(len(text) - w) // s)) + 1
    seen = [[text[i * s + j] if i * s + j < len(text) else quality.PAD for j in range(w)] for i in range(windows)]
    out = [net["bytes"][v].reshape(-1) @ net["filters"] + net["offsets"] for v in seen]
    starts = [0] + [b for b in range(quality.STEP, windows, quality.STEP) if b - quality.STEP + c < windows]
    return np.array([np.max(out[b : b + c], axis=0) for b in starts])


def test_network_covers_the_whole_text_and_has_right_gradients():
    net = {k: v.astype(np.float64) for k, v in quality.new_network().items()}
    rng = np.random.default_rng(0)
    for size in (0, 1, 11, 12, 13, 500, 521, 525, 5000, quality.SEGMENT * quality.STEP * quality.STRIDE + 900):
        text = rng.integers(97, 123, size).astype(np.uint8).tobytes()
        if size <= 5000:
            assert np.allclose(quality.pooled(net, text), slow_pool(net, text))
        assert np.allclose(quality.pooled(net, text), quality._winners(net, text)[0])
    # The last bytes count.
    text = b"plain words " * 4000
    assert quality.probability(net, text) != quality.probability(net, text[:-12] + b"#$%&*#$%&*#$")
    texts, labels = [b"hello world, this is a test " * 40, b"", b"AB!! " * 500], [1, 0, 0]
    _, slopes = quality.gradients(net, texts, labels)
    for name, value in net.items():
        at = (ord("l"), 2) if name == "bytes" else tuple(rng.integers(n) for n in value.shape)
        kept, losses = value[at], []
        for step in (1e-5, -1e-5):
            value[at] = kept + step
            losses.append(quality.gradients(net, texts, labels)[0])
        value[at] = kept
        assert abs((losses[0] - losses[1]) / 2e-5 - slopes[name][at]) < 1e-6


def slow_collocations(rows, least, longest, top):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q[s : s + m] for q, b in found.items() for m in range(2, len(q)) for s in range(len(q) - m + 1) if b >= f[q[s : s + m]]}
        kept = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((" ".join(p), a, f[p[:k]], f[p[k:]], total[lang], score))
        kept.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(kept[:top])]
    return sorted(out)


TEXTS = [
    "The cat sat on the mat, the cat sat on the mat. The dog; sat on\tthe  mat!" * 3, "a a a a a a a a a a", "A a? a\x0ba b\x0cc É é É é", "one two three four five six " * 4,
    "one two three. four five six", "new york new york new york", "", "...", "\x1fx \x1fx \x1fx \x1fx y z z", "the the the the, the",
]


@pytest.mark.parametrize("least,longest,top,sample", [(2, 5, 2000, 1), (3, 5, 4, 3), (2, 3, 2000, 7), (4, 5, 2000, 1000)])
def test_collocations(spark, least, longest, top, sample):
    rows, docs = odd_documents(spark, TEXTS * 2)
    langs = ["en", "de", None]
    docs = docs.withColumn("lang", F.element_at(F.array(*map(F.lit, langs)), (F.coalesce("doc_id", F.lit(0)) % 3 + 1).cast("int"))).repartition(3)
    rows = [(key, text, langs[(key or 0) % 3]) for key, text in rows]
    got = sorted(tuple(r) for r in phrases.collocations(docs, least, longest, top, sample).collect())
    assert got == slow_collocations(rows, least, longest, top)


def test_a_blind_sample_loses_nothing(spark, monkeypatch):
    """Nothing is proposed, so every frequent word is a failure and the further pass finds all."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    wanted = slow_collocations(rows, 30, 5, 2000)
    blind = lambda rows, least, longest: rows.sparkSession.createDataFrame([], "h bigint")
    monkeypatch.setattr(phrases, "_sampled", blind)
    assert wanted and sorted(tuple(r) for r in phrases.collocations(docs, 30).collect()) == wanted


def test_filters_that_are_full_and_long_texts_in_parts(spark, monkeypatch):
    """Everything passes a full filter, parts end between pieces, and counts stay exact."""
    monkeypatch.setattr(phrases, "FILTER_BITS", 6)
    monkeypatch.setattr(phrases, "RUN_BYTES", 50)
    monkeypatch.setattr(phrases, "HELD", 100)
    monkeypatch.setattr(phrases, "VOCABULARY", 20)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, lang string")
    got = sorted(tuple(r) for r in phrases.collocations(docs, 2).collect())
    assert got == slow_collocations([(i, t, "en") for i, t in enumerate(TEXTS)], 2, 5, 2000)


def test_collocations_of_nothing(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs, 10**9).count() == 0


def test_scores_past_64_bits_are_exact(spark, monkeypatch):
    big = 10**12
    made = [("en", 0, "", 7 * big), ("en", 1, "a", 3 * big), ("en", 1, "b", 2 * big + 1), ("en", 2, "a b", big + 7)]
    monkeypatch.setattr(phrases, "frequent_phrases", lambda docs, *rest: docs.sparkSession.createDataFrame(made, "lang string, size int, phrase string, f bigint"))
    (row,) = phrases.collocations(table(spark, "/root/testdata/sf0.001", "documents")).collect()
    assert row["score"] == 1000 * (big + 7) * 7 * big // (3 * big * (2 * big + 1))


def test_phrases_are_not_told_by_every_piece_of_the_input(spark):
    """Counts of phrases leave a task once; their number must not grow with the partitions."""
    rows = spark.createDataFrame([("en", bytearray(b"one two three")) for _ in range(300)], "lang string, text binary").repartition(100)
    words = phrases._count(rows, 3, lambda run: run.whole)
    made = phrases._spellings(rows, 3, phrases.make_filter(words)).collect()
    assert len(made) <= 7 * phrases.TURNS * spark.sparkContext.defaultParallelism
    total = {}
    for r in made:
        total[bytes(r["phrase"])] = total.get(bytes(r["phrase"]), 0) + r["c"]
    assert total == {b"": 900} | {p: 300 for p in (b"one", b"two", b"three", b"one two", b"two three", b"one two three")}


def test_a_new_vocabulary_makes_no_task_tell_its_phrases_again(spark):
    """One task meets far more words than a vocabulary holds; the counts so far go along."""
    texts = [" ".join(f"w{part}x{i}" for i in range(250_000)) + ". One two three." for part in range(4)]
    rows = spark.createDataFrame([("en", bytearray(t.encode())) for t in texts], "lang string, text binary").repartition(1)
    known = spark.createDataFrame([("en", bytearray(b"one two three"))], "lang string, text binary")
    made = phrases._spellings(rows, 3, phrases.make_filter(phrases._count(known, 3, lambda run: run.whole))).collect()
    told = {bytes(r["phrase"]): r["c"] for r in made if r["size"]}
    assert told == dict.fromkeys([b"one", b"two", b"three", b"one two", b"two three", b"one two three"], 4)
    assert len(made) == 7 and sum(r["c"] for r in made if not r["size"]) == 4 * 250_003


def test_counts_that_move_to_another_vocabulary_keep_their_words():
    old, new, held = phrases._Vocabulary(), phrases._Vocabulary(), phrases._Spelling(3)
    run = phrases.Run([("en", b"z y\na b c\na b c")], old, 3)
    held.add(run, np.flatnonzero(run.whole[2]), 2)
    held.odd.append(((old[b"b"], old[b"c"], -1), 0, 5))
    new[b"other"], new[b"b"]
    assert held.move(old, new) and set(new) == {b"other", b"a", b"b", b"c"}
    (found,) = held.batches(new)
    assert sorted(zip(found.column(2).to_pylist(), found.column(3).to_pylist())) == [(b"a b c", 2), (b"b c", 5)]
