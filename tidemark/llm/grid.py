"""Operator 2: near-duplicate vectors by an epsilon grid order join.

Unit vectors are projected on the leading principal dimensions and sorted by label and grid
cells as wide as the join distance. The sorted sequence is cut into intervals of bounded
size. Intervals whose boxes are provably farther apart than the distance never meet; the
others are joined recursively, halves against halves, and compared in double precision
once both are short. Equal vectors are one node with a weight, and a pair of
intervals tells link counts and a spanning set of edges, so no group yields all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, small_batches, stored

COSINE = 0.98
DIMENSIONS = 6
FIT_ROWS = 20_000
INTERVAL = 2048
LEAF = 128


def unit_rows(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(key, label, dim, digest, unit): digest is null where a vector links with nothing."""
    small_batches(vectors.sparkSession)
    source = vectors.select(vectors[id_column].alias("key"), vectors[label_column].cast("string").alias("label"), vectors[vector_column].cast("array<double>").alias("v"))

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            digests, units, dims = [], [], []
            for label, cell in zip(batch.column(1).to_pylist(), batch.column(2)):
                values = cell.values if cell.is_valid else None
                digest = unit = dim = None
                if label is not None and values is not None and len(values) and not values.null_count:
                    v = values.to_numpy() + 0.0  # one zero
                    top = np.abs(v).max()
                    if np.isfinite(v).all() and top > 0:
                        scaled = v / top
                        unit = (scaled / np.sqrt(scaled @ scaled)).tobytes()
                        digest, dim = hashlib.md5(f"{label}\n".encode() + v.tobytes()).hexdigest(), len(v)
                digests.append(digest)
                units.append(unit)
                dims.append(dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(digests, pa.string()), pa.array(units, pa.binary())], ["key", "label", "dim", "digest", "unit"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, label string, dim int, digest string, unit binary")


def principal_dimensions(nodes: DataFrame) -> dict[int, object]:
    """Leading principal directions by vector length, from the FIT_ROWS rows with the smallest hashes.

    Any directions give exact results; good ones skip more.
    """
    import numpy as np

    sample: dict[int, list] = {}
    for r in nodes.orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).select("dim", "unit").collect():
        sample.setdefault(r["dim"], []).append(np.frombuffer(r["unit"]))
    out = {}
    for dim, rows in sample.items():
        matrix = np.array(rows)
        values, directions = np.linalg.eigh(np.cov(matrix.T).reshape(dim, dim) if len(rows) > 1 else np.eye(dim))
        out[dim] = np.ascontiguousarray(directions[:, ::-1][:, : min(DIMENSIONS, dim)])
    return out


def _directions(fitted: dict, dim: int):
    import numpy as np

    if dim not in fitted:
        fitted[dim] = np.eye(dim)[:, : min(DIMENSIONS, dim)]
    return fitted[dim]


def intervals(nodes: DataFrame, fitted: dict, epsilon: float, size: int = INTERVAL) -> DataFrame:
    """The sorted sequence cut into rows of at most ``size`` vectors, with their boxes."""

    def cells(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = []
            for dim, unit in zip(batch.column(2).to_pylist(), batch.column(4)):
                found.append(np.floor(np.frombuffer(unit.as_py()) @ _directions(fitted, dim) / epsilon).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    schema = "rep bigint, label string, dim int, n bigint, unit binary"
    sorted_rows = nodes.select("rep", "label", "dim", "n", "unit").mapInArrow(cells, f"{schema}, cells array<int>")
    order = ["label", "dim", "cells", "rep"]
    sorted_rows = stored(sorted_rows, "vector-cells").repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, made, held, now = TaskContext.get().partitionId(), 0, [], None

        def flush():
            label, dim, _ = now
            places = np.array([np.frombuffer(h[2]) for h in held]) @ _directions(fitted, dim)
            row = {
                "id": part << 32 | made, "label": label, "dim": dim,
                "reps": np.array([h[0] for h in held], np.int64).tobytes(), "weights": np.array([h[1] for h in held], np.int64).tobytes(),
                "units": b"".join(h[2] for h in held), "low": places.min(axis=0).tolist(), "high": places.max(axis=0).tolist(),
            }
            kind = pa.schema([("id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("reps", pa.binary()), ("weights", pa.binary()), ("units", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
            return pa.RecordBatch.from_pylist([row], kind)

        for batch in batches:
            for rep, label, dim, n, unit, cell in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if held and (now[:2] != (label, dim) or len(held) >= size or len(held) >= size // 4 and now[2] != cell[0]):
                    yield flush()
                    made, held = made + 1, []
                now = label, dim, cell[0]
                held.append((rep, n, unit))
        if held:
            yield flush()

    return stored(sorted_rows.mapInArrow(cut, "id bigint, label string, dim int, reps binary, weights binary, units binary, low array<double>, high array<double>"), "vector-intervals")


def interval_pairs(found: DataFrame, epsilon: float) -> DataFrame:
    """(l, r) ids of intervals of one label whose boxes are not provably farther apart.

    Intervals meet by the cells of the first dimension that they cover, which are few: the
    sequence is sorted by them.
    """
    reach = epsilon * (1 + 1e-9)
    boxes = found.select("id", "label", "dim", "low", "high", F.floor(F.get("low", F.lit(0)) / epsilon).alias("c1"), F.floor(F.get("high", F.lit(0)) / epsilon).alias("c2"))
    left = boxes.select(F.col("id").alias("l"), "label", "dim", F.col("low").alias("l1"), F.col("high").alias("l2"), F.col("c1").alias("lc"), F.explode(F.sequence("c1", "c2")).alias("cell"))
    right = boxes.select(F.col("id").alias("r"), "label", "dim", F.col("low").alias("r1"), F.col("high").alias("r2"), (F.col("c1") - 1).alias("rc"), F.explode(F.sequence(F.col("c1") - 1, F.col("c2") + 1)).alias("cell"))
    gaps = F.zip_with(F.zip_with("l1", "r2", lambda a, b: a - b), F.zip_with("r1", "l2", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    distance = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    met = left.join(right, ["label", "dim", "cell"]).where((F.col("l") <= F.col("r")) & (F.col("cell") == F.greatest("lc", "rc")))
    return met.where(distance <= reach * reach).select("l", "r")


class IntervalJoin:
    """Link counts and connecting edges of two intervals, or of one with itself."""

    def __init__(self, a: dict, b: dict, directions, cosine: float, epsilon: float, leaf: int = LEAF):
        self.a, self.b, self.same, self.leaf = a, b, a["id"] == b["id"], leaf
        self.cosine, self.reach = cosine, epsilon * (1 + 1e-9)
        for side in (a, b):
            side["places"] = side["units"] @ directions
            side["count"] = side["weights"] * 0
            side["root"] = side["reps"].copy()
        if self.same:
            b["count"], b["root"] = a["count"], a["root"]
        self.edges: set[tuple[int, int]] = set()
        self.join(0, len(a["reps"]), 0, len(b["reps"]))

    def apart(self, i: int, j: int, k: int, m: int) -> bool:
        import numpy as np

        p, q = self.a["places"][i:j], self.b["places"][k:m]
        gap = np.maximum(np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)), 0.0)
        return float(gap @ gap) > self.reach * self.reach

    def join(self, i: int, j: int, k: int, m: int) -> None:
        if self.same and m <= i or self.apart(i, j, k, m):
            return
        if j - i <= self.leaf and m - k <= self.leaf:
            self.compare(i, j, k, m)
            return
        lefts = [(i, j)] if j - i <= self.leaf else [(i, (i + j) // 2), ((i + j) // 2, j)]
        rights = [(k, m)] if m - k <= self.leaf else [(k, (k + m) // 2), ((k + m) // 2, m)]
        for p in lefts:
            for q in rights:
                self.join(*p, *q)

    def compare(self, i: int, j: int, k: int, m: int) -> None:
        import numpy as np

        a, b = self.a, self.b
        near = a["units"][i:j] @ b["units"][k:m].T >= self.cosine
        if self.same:
            # Each pair once: the second place after the first.
            near &= np.arange(k, m)[None, :] > np.arange(i, j)[:, None]
        if not near.any():
            return
        a["count"][i:j] += near @ b["weights"][k:m]
        b["count"][k:m] += near.T @ a["weights"][i:j]
        none = np.iinfo(np.int64).max
        while True:
            left, right = a["root"][i:j].copy(), b["root"][k:m].copy()
            new_left = np.minimum(left, np.where(near, right[None, :], none).min(axis=1))
            new_right = np.minimum(right, np.where(near, new_left[:, None], none).min(axis=0))
            if self.same:
                # Both sides may be views of the same places.
                np.minimum.at(a["root"], np.arange(i, j), new_left)
                np.minimum.at(a["root"], np.arange(k, m), new_right)
            else:
                a["root"][i:j], b["root"][k:m] = new_left, new_right
            moved = False
            for old, new in ((left, new_left), (right, new_right)):
                changed = np.flatnonzero(old != new)
                moved |= len(changed) > 0
                self.edges.update(zip(old[changed].tolist(), new[changed].tolist()))
            if not moved:
                return


def join_pairs(pairs: DataFrame, found: DataFrame, fitted: dict, cosine: float, epsilon: float, leaf: int = LEAF) -> DataFrame:
    """(a, b, n): link counts of node a where b is null, edges a to b elsewhere."""
    sides = ["id", "dim", "reps", "weights", "units"]
    left = found.select(*(F.col(c).alias(f"l_{c}") for c in sides))
    right = found.select(*(F.col(c).alias(f"r_{c}") for c in sides))
    both = pairs.join(left, pairs["l"] == F.col("l_id")).join(right, F.col("r") == F.col("r_id")).select(*left.columns, *right.columns)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def side(row: dict, s: str) -> dict:
            return {
                "id": row[f"{s}_id"], "reps": np.frombuffer(row[f"{s}_reps"], np.int64), "weights": np.frombuffer(row[f"{s}_weights"], np.int64),
                "units": np.frombuffer(row[f"{s}_units"]).reshape(-1, row[f"{s}_dim"]),
            }

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                done = IntervalJoin(side(row, "l"), side(row, "r"), _directions(fitted, row["l_dim"]), cosine, epsilon, leaf)
                a, b, n = [], [], []
                for s in [done.a] if done.same else [done.a, done.b]:
                    linked = np.flatnonzero(s["count"])
                    a += s["reps"][linked].tolist()
                    b += [None] * len(linked)
                    n += s["count"][linked].tolist()
                a += [e[0] for e in done.edges]
                b += [e[1] for e in done.edges]
                n += [None] * len(done.edges)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], ["a", "b", "n"])

    return both.mapInArrow(run, "a bigint, b bigint, n bigint")


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", cosine: float = COSINE, interval: int = INTERVAL, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector row.

    Vectors with equal labels and lengths link if their cosine is at least ``cosine``.
    Null, empty and zero vectors, those with null or non-finite components or no label link
    with nothing. Repeated rows are vectors of their own that link with each other, and so are
    different vectors with one id; vectors without an id link like others, but name no
    component unless all of it lacks ids, and are not kept. Ids must
    be integers; an empty table gives an empty one. Other columns do not take part.
    """
    spark = vectors.sparkSession
    epsilon = (2 - 2 * cosine) ** 0.5
    # A group of copies is one node, known by the stored number of its first row: ids may repeat or be missing.
    rows = stored(unit_rows(vectors, id_column, vector_column, label_column).withColumn("row", F.monotonically_increasing_id()), "unit-vectors")
    same = rows.where("digest is not null").groupBy("digest").agg(F.min("row").alias("rep"), F.min("key").alias("low"), F.count("*").alias("n"))
    same = stored(same, "vector-copies")
    first = rows.select("row", "label", "dim", "unit").join(same, rows["row"] == same["rep"])
    nodes = stored(first.select("rep", "label", "dim", "n", "unit"), "vector-nodes")
    fitted = principal_dimensions(nodes)
    found = intervals(nodes, fitted, epsilon, interval)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row holds two intervals
    try:
        joined = stored(join_pairs(interval_pairs(found, epsilon), found, fitted, cosine, epsilon, leaf), "vector-links")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    counts = joined.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    groups = components(joined.where("b is not null").select("a", "b"))
    told = same.join(counts, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    told = told.select(F.col("digest").alias("of"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("root"), "low")
    told = stored(told, "vector-roots")
    lowest = told.groupBy("root").agg(F.min("low").alias("component"))
    told = told.select("of", "links", "root").join(lowest, "root")
    out = rows.select("key", "digest").join(told, F.col("digest") == F.col("of"), "left")
    component = F.coalesce("component", "key")
    return out.select(
        F.col("key").alias(id_column),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("key"), F.lit(False)).alias("kept"),
    )
