"""SimHash, near vectors and repeated lines against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from odd import by_id, odd_documents
from pyspark.sql import functions as F

from tidemark.llm import grid, lines, simhash
from tidemark.llm.shared import components


class Groups:
    def __init__(self):
        self.root = {}

    def top(self, x):
        while self.root.setdefault(x, x) != x:
            x = self.root[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.root[max(a, b)] = min(a, b)


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)] + [(5, 5)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    groups = Groups()
    for a, b in edges:
        groups.join(a, b)
    assert got == {x: groups.top(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def slow_simhash(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_documents_by_simhash(spark):
    r = random.Random(1)
    base = [" ".join(r.choice("Alpha beta gämma delta ÉPS zeta".split()) + str(r.randrange(50)) for _ in range(60)) for _ in range(6)]
    texts = []
    for i in range(60):
        words = base[i % 6].split()
        for _ in range(i % 3):
            words[r.randrange(60)] = "new"
        texts.append(" ".join(words))
    rows, docs = odd_documents(spark, [*texts, "one", "two Words", "\x1ca b\x0bc d"])
    got = by_id(simhash.near_duplicates(docs).collect())
    prints = {}
    for key, text in rows:
        prints.setdefault(slow_simhash(text), []).append(key)
    groups, seen = Groups(), sorted(prints)
    for i, a in enumerate(seen):
        groups.top(a)
        for b in seen[:i]:
            if (a ^ b).bit_count() <= 2:
                groups.join(a, b)
    lowest = {}
    for fp, keys in prints.items():
        known = [k for k in keys if k is not None]
        lowest[groups.top(fp)] = min([*known, lowest.get(groups.top(fp), 1 << 40)])
    for fp, keys in prints.items():
        low = lowest[groups.top(fp)]
        for key in keys:
            assert {(x["fingerprint"], x["component_id"]) for x in got[key]} == {(f"{fp:016x}", None if low == 1 << 40 else low)}
    assert sum(map(len, got.values())) == len(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [4096, 8])
def test_links_of_close_fingerprints(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    r = random.Random(7)
    values = set()
    for _ in range(40):
        v = r.getrandbits(64)
        for _ in range(8):
            values.add(v)
            v ^= 1 << r.randrange(64)
            if r.random() < 0.4:
                v ^= 1 << r.randrange(64)
    center = r.getrandbits(64)
    values |= {center ^ 1 << b for b in range(64)}
    signed = [(v - (v >> 63 << 64),) for v in values]
    got = Groups()
    for x in simhash.links(spark.createDataFrame(signed, "fp bigint")).collect():
        assert ((x["a"] ^ x["b"]) & (1 << 64) - 1) and x["a"] != x["b"]
        got.join(x["a"], x["b"])
    want = Groups()
    flat = [s for (s,) in signed]
    for i, a in enumerate(flat):
        for b in flat[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                want.join(a, b)
    assert {x: got.top(x) for x in flat} == {x: want.top(x) for x in flat}


def test_bk_tree_finds_all_within_the_radius():
    r = random.Random(3)
    values = [r.getrandbits(12) for _ in range(500)]
    tree = simhash.BkTree()
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 37):
        assert sorted(tree.near(q, 2)) == sorted({v for v in values if (v ^ q).bit_count() <= 2})


def slow_vectors(rows, cosine=0.98):
    units = {}
    for i, (_, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, float)
            units[i] = a / np.sqrt(a @ a)
    groups, links = Groups(), [0] * len(rows)
    for i in range(len(rows)):
        groups.top(rows[i][0])
    for i in units:
        for j in units:
            if j < i and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                links[i] += 1
                links[j] += 1
                groups.join(rows[i][0], rows[j][0])
    return [(rows[i][0], links[i], groups.top(rows[i][0]), groups.top(rows[i][0]) == rows[i][0]) for i in range(len(rows))]


@pytest.mark.parametrize("interval, leaf", [(2048, 128), (40, 6)])
def test_near_vectors(spark, interval, leaf):
    rng = np.random.default_rng(0)
    base, rows = rng.normal(size=(25, 8)), []
    for i in range(500):
        v = base[0] if i % 3 == 0 else base[rng.integers(25)] + rng.normal(size=8) * 0.12
        rows.append((i * 7 - 900, [float(x) for x in v], int(rng.integers(2))))
    rows += [(9001, None, 1), (9002, [0.0] * 8, 1), (9003, [float("nan")] * 8, 0), (9004, [1.0] * 8, None), (9005, [None] + [1.0] * 7, 0), (9006, [], 0)]
    rows += [(9007, [2.0, 0.0], 0), (9008, [5.0, -0.0], 0), (9009, [float("inf")] * 2, 0), (9010, [1e-200, 1e-200], 1), (9011, [1e200, 1e200], 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, key string, n int").repartition(5)
    got = grid.near_vectors(frame, interval=interval, leaf=leaf).collect()
    want = {r[0]: r for r in slow_vectors([x if x[0] < 9010 else (x[0], [1.0, 1.0], 1) for x in rows])}
    assert {r["vec_id"]: tuple(r) for r in got} == want
    assert grid.near_vectors(frame.limit(0)).count() == 0


def test_repeated_vector_rows_link(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)], "vec_id bigint, embedding array<float>, label int")
    assert sorted(tuple(r) for r in grid.near_vectors(frame).collect()) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_vectors_that_share_or_lack_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.001]), (None, [1.0, 0.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0]), (4, [2.0, 2.0])]
    frame = spark.createDataFrame([(k, v, 0) for k, v in rows] + [(None, None, 0), (None, [-1.0, 0.0], 0)], "vec_id bigint, embedding array<double>, label int")
    got = sorted((tuple(r) for r in grid.near_vectors(frame).collect()), key=repr)
    want = [(1, 2, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 2, 1, False), (None, 2, 1, False), (None, 2, 4, False), (None, 2, 4, False), (4, 2, 4, True), (None, 0, None, False), (None, 0, None, False)]
    assert got == sorted(want, key=repr)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return a == b
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def slow_lines(rows):
    """Places (id, line) that go, with the id that holds the first of their class."""
    found = sorted((k is not None, k or 0, p, x) for k, t in rows if t is not None for p, x in enumerate(t.split("\n")) if len(x) >= lines.MIN_CHARS)
    texts, groups = sorted({f[3] for f in found}), Groups()
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if one_edit(a, b):
                groups.join(a, b)
    first, gone = {}, {}
    for f in found:
        at = first.setdefault(groups.top(f[3]), f[:3])
        if at != f[:3]:
            gone[f[1] if f[0] else None, f[2]] = at[1] if at[0] else None
    return gone


def test_repeated_lines(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh éß🙂") for _ in range(r.randint(18, 40))) for _ in range(30)]
    texts = []
    for _ in range(150):
        found = []
        for _ in range(r.randint(0, 5)):
            line = list(r.choice(base[:4]) if r.random() < 0.6 else r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                p, kind = r.randrange(len(line)), r.random()
                line[p : p + (kind > 0.4)] = [] if kind > 0.7 else r.choice("abcxyz")
            found.append("".join(line))
        texts.append("\n".join(found))
    rows, docs = odd_documents(spark, [*texts, "y" * 20 + "\n" + "y" * 21 + "\n" + "y" * 22, "only short\nonly short"])
    gone = slow_lines(rows)
    got = by_id(lines.dedup_lines(docs).collect())
    assert sum(map(len, got.values())) == len(rows)
    for key, text in rows:
        for g in got[key]:
            if text is None:
                assert g["text"] is None and g["n_lines"] == 0
                continue
            parts = text.split("\n")
            dropped = [p for p in range(len(parts)) if (key, p) in gone]
            assert g["text"] == "\n".join(x for p, x in enumerate(parts) if p not in dropped)
            assert (g["n_lines"], g["n_dropped"]) == (len(parts), len(dropped))
            assert set(g["repeats_of"]) == {gone[key, p] for p in dropped}
    kept = lines.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert lines.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_edit_distance(spark, edits):
    r, rows = random.Random(edits), []
    for _ in range(800):
        a = [r.choice("abé🙂") for _ in range(r.randint(0, 14))]
        b = list(a)
        for _ in range(r.randint(0, 5)):
            p, kind = r.randint(0, len(b)), r.random()
            b[p : p + (kind > 0.4)] = [] if kind > 0.7 else r.choice("abc")
        rows.append(("".join(a), "".join(b)))
    frame = spark.createDataFrame(rows, "a string, b string")
    both = frame.select(lines.edit_distance(F.col("a"), F.col("b"), edits).alias("x"), F.levenshtein("a", "b").alias("y")).collect()
    assert all(min(q["x"], edits + 1) == min(q["y"], edits + 1) for q in both)


def test_a_key_of_many_lines_yields_no_pairs(spark):
    """Lines that differ at one place pairwise are linked by a star."""
    many = ["prefix of the line " + chr(0x4E00 + i) + " and its end" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(many)), "doc_id bigint, text string")
    wanted = lines._shared(lines._first_keys(lines.split_lines(docs, "doc_id", "text").select("line")), "line").select("key")
    assert lines.edit_links(lines.split_lines(docs, "doc_id", "text"), wanted).count() < 1000
    got = lines.dedup_lines(docs).collect()
    assert [r["doc_id"] for r in got if not r["n_dropped"]] == [0]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("key_pairs, map_bits", [(4096, 1 << 28), (4, 1 << 28), (4096, 8)])
def test_threshold_grows_with_the_line(spark, monkeypatch, key_pairs, map_bits):
    monkeypatch.setattr(lines, "KEY_PAIRS", key_pairs)
    monkeypatch.setattr(lines, "MAP_BITS", map_bits)
    r, texts = random.Random(9), set()
    base = ["".join(r.choice("abcdefgh éß🙂") for _ in range(n)) for n in (20, 33, 49, 50, 75, 101, 120)]
    for line in base:
        for _ in range(16):
            made = list(line)
            for _ in range(r.randint(0, 5)):
                p, kind = r.randrange(len(made)), r.random()
                made[p : p + (kind > 0.4)] = [] if kind > 0.7 else r.choice("abcxyz")
            texts.add("".join(made))
    texts = sorted(t for t in texts if len(t) >= lines.MIN_CHARS)
    want, got = Groups(), Groups()
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if abs(len(a) - len(b)) < 9 and distance(a, b) <= 1 + min(len(a), len(b)) // 25:
                want.join(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for x in lines.repeated_lines(docs, share=0.04).collect():
        got.join(texts[x["doc"]], texts[x["first_doc"]])
    assert {x: got.top(x) for x in texts} == {x: want.top(x) for x in texts}
    assert lines.repeated_lines(docs.limit(0), share=0.04).count() == 0


def test_greatest_number_of_edits_and_least_length_are_parameters(spark):
    texts = ["abcdefghij" * 6, "abcdefghij" * 5 + "xxxdefghij", "short one", "short ones"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    dropped = lambda **kw: {r["doc"] for r in lines.repeated_lines(docs, share=0.05, **kw).collect()}
    assert dropped() == {1} and dropped(most=2) == set() and dropped(most=2, min_chars=5) == {3}
    with pytest.raises(ValueError):
        lines.repeated_lines(docs, most=15)


def test_map_of_keys_loses_none(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    rows = spark.range(20000).select("id", F.xxhash64("id").alias("key"))
    left = {r["id"] for r in lines._sifted(rows, keys, 5000).collect()}
    assert left >= set(range(5000)) and len(left) < 7000


@pytest.mark.parametrize("key_pairs", [4096, 4])
def test_near_copies_with_too_many_changes_are_not_paired(spark, monkeypatch, key_pairs):
    """They share segments, but their letters tell that more edits lie between them than a link may have."""
    r, made = random.Random(4), []
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base = " ".join(word(6) for _ in range(40))
    texts = {base}
    while len(texts) < 60:
        words = base.split()
        for at in r.sample(range(5, 40), 3):
            words[at] = word(6)
        texts.add(" ".join(words))
    # Links among the rest: one letter, and characters that are not counted.
    texts |= {t.replace(t[100], "é", 1) for t in sorted(texts)[:9]}
    texts = sorted(texts)
    verified = lines.verified
    monkeypatch.setattr(lines, "KEY_PAIRS", key_pairs)
    monkeypatch.setattr(lines, "verified", lambda pairs, edits: made.append(pairs.count()) or verified(pairs, edits))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want, got = Groups(), Groups()
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if distance(a, b) <= 1 + min(len(a), len(b)) // 100:
                want.join(a, b)
    for x in lines.repeated_lines(docs, share=0.01).collect():
        got.join(texts[x["doc"]], texts[x["first_doc"]])
    assert {x: got.top(x) for x in texts} == {x: want.top(x) for x in texts}
    assert len({want.top(x) for x in texts}) < len(texts) and sum(made) < 3 * len(texts)
