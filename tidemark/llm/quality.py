"""Operator 12: document quality by a convolutional network over bytes, in numpy.

Bytes get learned vectors; learned filters slide over windows of WIDTH bytes. Chunks of CHUNK
windows, each of which shares a quarter with its neighbour, cover the whole document; every
filter's maximum in a chunk is kept, and the mean and the maximum of these over all chunks pass
a hidden layer into one probability. The network is trained by Adam on a bounded sample of
labelled rows, in one task, from fixed seeds.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, stored

# The sample: the rows with the smallest hashes of their id, at most so many rows and bytes.
TRAIN_ROWS = 3_000
TRAIN_BYTES = 32 << 20
THRESHOLD = 0.7
PAD, BYTE_SIZE = 256, 8
STRIDE, WIDTH = 4, 12
FILTERS, HIDDEN = 40, 24
CHUNK, STEP = 128, 96
SEGMENT = 256
EPOCHS, BATCH, RATE, DECAY = 6, 32, 4e-3, 1e-4
SEED = 3


def new_network(seed: int = SEED) -> dict:
    import numpy as np

    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "bytes": draw(PAD + 1, BYTE_SIZE, scale=0.5),
        "filters": draw(WIDTH * BYTE_SIZE, FILTERS, scale=(WIDTH * BYTE_SIZE) ** -0.5),
        "offsets": np.zeros(FILTERS, np.float32),
        "hidden": draw(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5),
        "hidden_offsets": np.zeros(HIDDEN, np.float32),
        "out": draw(HIDDEN, scale=HIDDEN**-0.5),
        "out_offset": np.zeros(1, np.float32),
    }


def _segments(text: bytes) -> Iterator[tuple]:
    """Byte values padded to whole windows, with the begins and ends of chunks in windows.

    A segment holds at most SEGMENT chunks, so a very long text is never expanded as a whole.
    """
    import numpy as np

    windows = max(0, -(-(len(text) - WIDTH) // STRIDE)) + 1
    chunks = max(0, -(-(windows - CHUNK) // STEP)) + 1
    for first in range(0, chunks, SEGMENT):
        count = min(SEGMENT, chunks - first)
        begin, end = first * STEP, min(windows, (first + count - 1) * STEP + CHUNK)
        values = np.full((end - begin - 1) * STRIDE + WIDTH, PAD, np.uint16)
        raw = np.frombuffer(text, np.uint8)[begin * STRIDE : begin * STRIDE + len(values)]
        values[: len(raw)] = raw
        starts = np.arange(count) * STEP
        yield values, starts, np.minimum(starts + CHUNK, end - begin)


def _responses(net: dict, values):
    """Windows by filters: blocks of STRIDE bytes times the filters' parts, shifted and added."""
    blocks = net["bytes"][values].reshape(-1, STRIDE * BYTE_SIZE)
    parts = net["filters"].reshape(WIDTH // STRIDE, STRIDE * BYTE_SIZE, FILTERS)
    n = len(blocks) - len(parts) + 1
    out = blocks[:n] @ parts[0]
    for i in range(1, len(parts)):
        out += blocks[i : i + n] @ parts[i]
    return out


def pooled(net: dict, text: bytes):
    """The largest response of every filter in every chunk of the whole text, with the offsets added."""
    import numpy as np

    found = []
    for values, starts, ends in _segments(text):
        out = _responses(net, values)
        if len(starts) == 1:
            found.append(out.max(axis=0, keepdims=True))
        else:
            # Pairs of begin and end; an end at the last window would lie outside.
            pairs = np.stack([starts, ends], axis=1).ravel()
            pairs = pairs[:-1] if pairs[-1] >= len(out) else pairs
            found.append(np.maximum.reduceat(out, pairs, axis=0)[::2])
    return np.concatenate(found) + net["offsets"]


def _winners(net: dict, text: bytes):
    """As :func:`pooled`, with the bytes of the window that won for every chunk and filter."""
    import numpy as np

    found, seen = [], []
    for values, starts, ends in _segments(text):
        out = _responses(net, values)
        at = np.array([b + out[b:e].argmax(axis=0) for b, e in zip(starts.tolist(), ends.tolist())])
        found.append(np.take_along_axis(out, at, axis=0))
        seen.append(values[at[..., None] * STRIDE + np.arange(WIDTH)])
    return np.concatenate(found) + net["offsets"], np.concatenate(seen)


def _head(net: dict, chunks):
    """Active chunk maxima, their summary, hidden values and the final logit of one text."""
    import numpy as np

    active = np.maximum(chunks, 0)
    summary = np.concatenate([active.mean(axis=0), active.max(axis=0)])
    hidden = np.maximum(summary @ net["hidden"] + net["hidden_offsets"], 0)
    return active, summary, hidden, float(hidden @ net["out"] + net["out_offset"][0])


def probability(net: dict, text: bytes) -> float:
    import numpy as np

    return float(1 / (1 + np.exp(-np.clip(_head(net, pooled(net, text))[3], -30, 30))))


def gradients(net: dict, texts: list[bytes], labels: list[int]):
    """Mean log loss of some texts and its gradients; only winning windows pass one on."""
    import numpy as np

    total, loss = {k: np.zeros_like(v) for k, v in net.items()}, 0.0
    shares, windows = [], []
    for text, label in zip(texts, labels):
        chunks, seen = _winners(net, text)
        active, summary, hidden, logit = _head(net, chunks)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss -= np.log(max(1e-12, p if label else 1 - p))
        slope = np.float32((p - label) / len(texts))
        total["out"] += slope * hidden
        total["out_offset"] += slope
        back = slope * net["out"] * (hidden > 0)
        total["hidden"] += np.outer(summary, back)
        total["hidden_offsets"] += back
        of_summary = net["hidden"] @ back
        share = np.tile(of_summary[:FILTERS] / len(active), (len(active), 1))
        share[active.argmax(axis=0), np.arange(FILTERS)] += of_summary[FILTERS:]
        share = (share * (chunks > 0)).astype(np.float32)
        total["offsets"] += share.sum(axis=0)
        shares.append(share)
        windows.append(seen)
    share, seen = np.concatenate(shares), np.concatenate(windows)
    at = np.flatnonzero(share.ravel())
    which, share, seen = at % FILTERS, share.ravel()[at], seen.reshape(-1, WIDTH)[at]
    inputs = net["bytes"][seen].reshape(len(at), -1) * share[:, None]
    order = np.argsort(which, kind="stable")
    filled, starts = np.unique(which[order], return_index=True)
    if len(at):
        total["filters"][:, filled] = np.add.reduceat(inputs[order], starts, axis=0).T
    passed = (net["filters"].T[which] * share[:, None]).reshape(-1, BYTE_SIZE)
    flat = seen.ravel().astype(np.int64)
    for i in range(BYTE_SIZE):
        total["bytes"][:, i] = np.bincount(flat, passed[:, i], PAD + 1)
    return loss / len(texts), total


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Adam over shuffled batches, with a step that falls to zero; equal inputs give equal networks."""
    import numpy as np

    net, rng = new_network(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    share = min(max(sum(labels) / len(labels), 1e-3), 1 - 1e-3)
    net["out_offset"][:] = np.log(share / (1 - share))
    step, steps = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for begin in range(0, len(texts), BATCH):
            some = order[begin : begin + BATCH]
            _, slopes = gradients(net, [texts[i] for i in some], [labels[i] for i in some])
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for k, g in slopes.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net[k] -= rate * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7) + DECAY * net[k])
    return net


def remainder(id_column):
    """crc32 of the id as text, modulo 4: 2 marks held-out rows."""
    return F.crc32(id_column.cast("string")) % 4


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> DataFrame:
    """(key, quality, text, place): at most ``rows`` labelled texts of ``size`` bytes together, held-out ids excluded.

    Null ids and null labels teach nothing; the label of an id that is listed more than once is its largest.
    """
    known = labels.select(labels["doc_id"].alias("key"), labels["quality"].cast("int").alias("quality")).where("key is not null and quality is not null")
    known = known.groupBy("key").agg(F.max("quality").alias("quality")).where(remainder(F.col("key")) != 2)
    order = [F.xxhash64("key"), F.col("key")]
    picked = known.orderBy(*order).limit(rows)
    texts = docs.select(docs["doc_id"].alias("key"), F.coalesce(docs["text"].cast("binary"), F.lit(b"")).alias("text"))
    # At most ``rows`` ids are sent everywhere; an id that many rows repeat is cut off by the second limit.
    found = texts.join(F.broadcast(picked), "key").orderBy(*order, F.xxhash64("text")).limit(rows)
    found = stored(found, "labelled")
    running = Window.orderBy(*order, F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("place", F.row_number().over(Window.orderBy(*order, F.xxhash64("text")))).withColumn("size", F.sum(F.octet_length("text")).over(running)).where(F.col("size") <= size).drop("size")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> bytes | float:
    """The trained network as bytes, or the share of label 1 (0.5 without labels) if a class is missing."""
    sample = stored(labelled_sample(docs, labels, rows, size), "quality-sample")
    told = sample.agg(F.avg("quality").alias("share"), F.countDistinct("quality").alias("kinds")).first()
    if told["kinds"] < 2:
        return float(told["share"]) if told["share"] is not None else 0.5

    def learn(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        texts, marks = [], []
        for batch in batches:
            texts += [t.as_py() for t in batch.column(0)]
            marks += batch.column(1).to_pylist()
        if texts:
            out = io.BytesIO()
            np.savez(out, **train(texts, marks))
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["net"])

    ordered = sample.select("text", "quality", "place").repartition(1).sortWithinPartitions("place").select("text", "quality")
    return bytes(stored(ordered.mapInArrow(learn, "net binary"), "quality-network").first()["net"])


def score(docs: DataFrame, model: bytes | float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its whole text alone.

    Null and empty texts get the score of an empty text. A null id is not held out. Repeated rows get
    equal scores.
    """
    small_batches(docs.sparkSession)
    source = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("binary").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        net = None if isinstance(model, float) else dict(np.load(io.BytesIO(model)))
        for batch in batches:
            found = [model if net is None else probability(net, t.as_py() or b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
    held_out = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels and score every document."""
    return score(docs, fit(docs, labels))
