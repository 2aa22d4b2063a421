"""Operator 4: near-duplicate documents by SimHash fingerprints and BK-trees.

Distinct fingerprints go to shards by the values of two of four 16-bit blocks: two that
differ in at most two bits agree in at least two blocks. A shard's tree keys each child by
its Hamming distance to the parent, and a search follows only edges within the radius.
Shards have a size bound; a larger group of fingerprints is cut into several, and each
tree is searched by each of them. Trees are sent by key to the tasks that search
them and never to all executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, small_batches, stored

RADIUS = 2
WORDS = 3
SEED = 42
SHARD = 4096
BLOCKS = 4


def simhash(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Fingerprint of one text: see ``fingerprints``."""
    return _simhashes([text], words, seed)[0]


def _simhashes(texts, size: int, seed: int) -> list[int]:
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    out = []
    for text in texts:
        # bytes.lower touches A-Z alone and bytes.split the six ASCII blanks alone.
        tokens = text.encode("utf-8", "replace").lower().split() if text else []
        if not tokens:
            out.append(0)
            continue
        if len(tokens) < size:
            out.append(digest(b" ".join(tokens), seed))
            continue
        shingles = [b" ".join(s) for s in zip(*(tokens[i:] for i in range(size)))]
        ones = np.zeros(64, np.int64)
        for at in range(0, len(shingles), 8192):
            hashes = np.array([digest(s, seed) for s in shingles[at : at + 8192]], "<u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        out.append(int(weights[2 * ones > len(shingles)].sum(dtype=np.uint64)))
    return out


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id column, fp as signed 64-bit) of every text.

    A-Z become lower case, words are runs without ASCII blanks, shingles of ``words`` words
    are hashed by XXH64, and a bit is set if over half the shingles, repeats included,
    set it. Fewer words make one shingle; none (null or blank texts) give zero.
    """
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_column].alias("key"), docs[text_column].alias("body"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = np.array(_simhashes((t.as_py() for t in batch.column(1)), words, seed), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["key", "fp"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, fp bigint").withColumnRenamed("key", id_column)


class BkTree:
    """Distinct fingerprints; children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        while new:
            distance = (self.values[at] ^ value).bit_count()
            if distance == 0:
                return
            if distance not in self.children[at]:
                self.children[at][distance] = new
                break
            at = self.children[at][distance]
        self.values.append(value)
        self.children.append({})

    def near(self, value: int, radius: int) -> list[int]:
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            at = open_nodes.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(self.values[at])
            for edge, child in self.children[at].items():
                if distance - radius <= edge <= distance + radius:
                    open_nodes.append(child)
        return found


def shard_links(first: list[int], second: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that connect what two shards link: at most one per fingerprint.

    The tree holds the first shard; fingerprints of both search it. A second list that is
    empty means links within the first.
    """
    tree, root = BkTree(), {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def search(value: int) -> None:
        for other in tree.near(value, radius):
            a, b = top(value), top(other)
            if a != b:
                root[max(a, b)] = min(a, b)

    for value in first:
        if not second:
            search(value)
        tree.add(value)
    for value in second:
        search(value)
    return [(x, top(x)) for x in root if top(x) != x]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``radius`` bits.

    ``prints`` holds distinct fingerprints in column fp. Exact for a radius of at most 2.
    """
    if radius > BLOCKS - 2:
        raise ValueError(f"blocks find pairs within {BLOCKS - 2} bits")
    width = 64 // BLOCKS
    keys = []
    for i, (one, two) in enumerate(combinations(range(BLOCKS), 2)):
        part = [F.shiftrightunsigned("fp", width * b).bitwiseAND((1 << width) - 1) for b in (one, two)]
        keys.append(F.lit(i << 2 * width).cast("bigint") + F.shiftleft(part[0], width) + part[1])
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("k"))
    sizes = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    # A group over the bound is cut into shards by hash; every pair of shards is one piece
    # of work, and its key names both.
    shards = F.ceil(F.col("n") / SHARD).cast("int")
    own = F.pmod(F.hash("fp"), F.col("shards"))
    dealt = (
        keyed.join(sizes, "k")
        .withColumn("shards", shards)
        .withColumn("own", own)
        .select("k", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other"))
        .select("k", F.least("own", "other").alias("s1"), F.greatest("own", "other").alias("s2"), "fp", "own")
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, first, second = None, [], []

        def solved():
            edges = shard_links(first, second, radius) if len(first) + len(second) > 1 and (first and second or now[1] == now[2]) else []
            signed = [(a - (a >> 63 << 64), b - (b >> 63 << 64)) for a, b in edges]
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in signed], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for k, s1, s2, fp, own in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (k, s1, s2) != now:
                    if now and len(first) + len(second) > 1:
                        yield solved()
                    now, first, second = (k, s1, s2), [], []
                (first if own == s1 else second).append(fp & (1 << 64) - 1)
        if now and len(first) + len(second) > 1:
            yield solved()

    return dealt.repartition("k", "s1", "s2").sortWithinPartitions("k", "s1", "s2", "fp").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """Id column, fingerprint (16 hex digits) and component_id of every document.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    component_id is the smallest id that links reach, the document's own included. Equal
    fingerprints are one node, whatever their number. Repeated rows share a component;
    null ids take part and get their group's smallest other id, or null; an empty table
    gives an empty one. Other columns do not take part.
    """
    prints = stored(fingerprints(docs, id_column, text_column), "fingerprints").withColumnRenamed(id_column, "key")
    nodes = stored(prints.groupBy("fp").agg(F.min("key").alias("low")), "prints")
    groups = components(stored(links(nodes.select("fp"), radius), "links"))
    joined = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    of_print = joined.join(lowest, "root").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(of_print, "fp").select(F.col("key").alias(id_column), shown, "component_id")
