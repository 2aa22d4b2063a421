"""Operator 7: token ids as canonical length-limited Huffman codes, decoded in blocks.

File format (little-endian numbers): magic, number of ids, ids per block, number of
symbols, bytes of code, number of documents; code lengths (one byte per symbol); document
keys (i64), whether a key is null (one byte each), ids per document (u64); the bit offset
of every block (u64); the code, most significant bit first, padded with eight zero bytes. Codes are
canonical: by length, then by symbol. All files of a run share one code made from global
counts, so any block of any file decodes without another.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path
from .bpe import byte_letters
from .shared import commit, file_system, small_batches, stored

MAGIC = b"TIDEHUF1"
MAX_BITS = 18
BLOCK_IDS = 256
FILE_IDS = 4_000_000
CACHE_WORDS = 500_000
# How vocabularies of words mark a word's last token, and their split pattern.
WORD_END = "</w>"
# Marks that make one word of their own after a word; an apostrophe may begin a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# The letters below are composed ones, of which all but one keep a single letter in lower case.
NOT_LATIN, DOTTED = "\u0250", "\u0130"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def code_lengths(counts, limit: int = MAX_BITS):
    """Code length of every symbol by package-merge: optimal among codes of at most ``limit`` bits.

    Symbols with count 0 get length 0. One used symbol gets one bit.
    """
    import numpy as np

    counts = np.asarray(counts, dtype=np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order]
    level, levels = weights, []
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weights))
        level = both[rank]
    # From the last list down: of the cheapest items, leaves add a bit to their symbol and
    # packages ask for twice as many items of the list below.
    take = 2 * len(order) - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    lengths[order[:take]] += 1
    return lengths


def canonical(lengths):
    """Code word of every symbol from the code lengths alone."""
    import numpy as np

    lengths = np.asarray(lengths, dtype=np.int64)
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        step = np.uint64(1) << (MAX_BITS - lengths[order]).astype(np.uint64)
        first = np.concatenate([[np.uint64(0)], np.cumsum(step)[:-1]]).astype(np.uint64)
        codes[order] = first >> (MAX_BITS - lengths[order]).astype(np.uint64)
    return codes


def pack(keys, sizes, ids, lengths, codes) -> bytes:
    """One file's bytes: documents by key and size, and all their ids."""
    import numpy as np

    ids = np.asarray(ids, dtype=np.int64)
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    starts = ends - bits
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    if len(ids):
        at, shift = starts >> 6, 64 - (starts & 63) - bits
        value = codes[ids]
        over = shift < 0
        high = np.where(over, value >> np.maximum(-shift, 0).astype(np.uint64), value << np.maximum(shift, 0).astype(np.uint64))
        heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        words[at[heads]] = np.bitwise_or.reduceat(high, heads)
        # At most one code word runs over the end of each 64 bits.
        words[at[over] + 1] |= value[over] << (64 + shift[over]).astype(np.uint64)
    body = words.astype(">u8").tobytes()[: (total + 7) // 8] + bytes(8)
    offsets = starts[::BLOCK_IDS].astype("<u8")
    head = MAGIC + struct.pack("<QIIQQ", len(ids), BLOCK_IDS, len(lengths), len(body), len(keys))
    named = np.array([k or 0 for k in keys], "<i8").tobytes() + bytes(k is None for k in keys) + np.array(sizes, "<u8").tobytes()
    return head + np.asarray(lengths, np.uint8).tobytes() + named + offsets.tobytes() + body


def decode_table(lengths):
    """Symbol and length for every pattern of MAX_BITS bits."""
    import numpy as np

    symbols, sizes = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
    lengths = np.asarray(lengths, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (MAX_BITS - lengths[order])
    filled = int(span.sum())
    symbols[:filled] = np.repeat(order, span)
    sizes[:filled] = np.repeat(lengths[order], span)
    return symbols, sizes


def unpack(data: bytes, tables: dict | None = None):
    """Keys, sizes and ids of a file. All blocks advance together, one table look-up per id."""
    import numpy as np

    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n, block, symbols_n, body_n, docs = struct.unpack_from("<QIIQQ", data, 8)
    at = 40
    raw = data[at : at + symbols_n]
    at += symbols_n
    keys = [None if gone else k for k, gone in zip(np.frombuffer(data, "<i8", docs, at).tolist(), data[at + 8 * docs : at + 9 * docs])]
    sizes_of = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    blocks = -(-n // block)
    pos = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
    at += 8 * blocks
    if len(data) != at + body_n:
        raise ValueError("token file is cut short")
    tables = {} if tables is None else tables
    if raw not in tables:
        tables.clear()
        tables[raw] = decode_table(np.frombuffer(raw, np.uint8))
    symbols, sizes = tables[raw]
    code = np.frombuffer(data, np.uint8, body_n, at).astype(np.uint32)
    window = (code[:-3] << 24) | (code[1:-2] << 16) | (code[2:-1] << 8) | code[3:]
    out = np.zeros((block, blocks), np.uint32)
    shift, mask, last = 32 - MAX_BITS, (1 << MAX_BITS) - 1, n - (blocks - 1) * block
    for i in range(block if blocks else 0):
        if i == last and blocks:
            pos = pos[:-1]
        seen = (window[pos >> 3] >> (shift - (pos & 7)).astype(np.uint32)) & mask
        out[i, : len(pos)] = symbols[seen]
        pos = pos + sizes[seen]
    return keys, sizes_of, out.T.reshape(-1)[:n]


class _Words(dict):
    """Ids, as bytes, of the text between two blanks; up to CACHE_WORDS of them are kept.

    A word of Latin letters goes to the model itself: in lower case, which composed letters
    keep, neither normalizer nor split changes it. Case is dropped, and marks after a word are
    a word of their own. All else goes through the whole tokenizer.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize, self.code = self.tokenizer.model.tokenize, {"<u2": "H", "<u4": "I"}[kind]

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(MARKS)
        low, stop = word.lower(), piece[len(word) :]
        if not word.isalpha() or not (word.isascii() or max(word) < NOT_LATIN and DOTTED not in word):
            ids = self.text(piece)
        elif low != piece:
            ids = self[low] + self[stop] if stop else self[low]
        else:
            spelled = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
            found = [token.id for token in self.tokenize(spelled)]
            ids = struct.pack(f"<{len(found)}{self.code}", *found)
        self[piece] = ids
        return ids

    def text(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes() if text else b""

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of every text; words met after the bound is reached are forgotten with their texts."""
        out = [b"".join(map(self.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]
        while len(self) > CACHE_WORDS:
            self.popitem()
        return out


_loaded: dict[str, _Words] = {}


def splits_at_blanks(path: str) -> bool:
    """Is this a tokenizer whose words can be encoded one by one, case dropped, stops apart?

    True only for what ``_Words`` relies on: white space and case go in the normalizer,
    the split keeps only its matches by a pattern that ends words at blanks and parts
    letters from stops, and the last token of a word, and no other, is marked.
    """
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = parts[0] if parts else {}
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [p["type"] for p in parts] == ["Split", "ByteLevel"]
        and (first["pattern"], first["behavior"], first["invert"]) == ({"Regex": WORD_PATTERN}, "Removed", True)
        and not parts[1]["add_prefix_space"]
        and not parts[1].get("use_regex", True)
        and spec["model"]["type"] == "BPE"
        and not spec["model"].get("dropout")
        and spec["model"].get("end_of_word_suffix") == WORD_END
        and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["content"].isalpha() for t in spec["added_tokens"])
    )


def id_kind(path: str, end_id: int) -> str:
    """Two bytes an id where the vocabulary allows, else four."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _encode(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """(key, ids as bytes) of every text with the end id appended."""
    apart = splits_at_blanks(path)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if path not in _loaded:
            _loaded[path] = _Words(path, kind)
        words = _loaded[path]
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if apart:
                out = [ids + end for ids in words.texts(texts)]
            else:
                out = [words.text(t) + end for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "ids"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, ids binary")


def _count(ids: DataFrame, kind: str) -> DataFrame:
    """Global count of every id."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            if len(seen) > len(total):
                total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
            total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode texts and write files of ids in ascending order of an integer id to ``folder``.

    A file is complete after FILE_IDS ids and the document they end in, and is renamed into
    place then. Returns the manifest, one row per file: part (order of files), file, n_ids,
    n_docs. Null text counts as empty: the end id alone. Rows with a null id come first,
    repeated rows are each written, ties ordered by their ids' bytes; an empty table
    makes no file. Other columns do not take part.
    """
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_column].cast("bigint").alias("key"), docs[text_column].alias("body"))
    # Encoded once; counting, sampling of ranges and writing all read this table.
    kind = id_kind(path, end_id)
    ids = stored(_encode(source, path, end_id, kind), "ids")
    rows = _count(ids, kind).collect()  # bounded by the vocabulary
    counts = [0] * (max([end_id, *(r["id"] for r in rows)]) + 1)
    for r in rows:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    parts = max(1, -(-sum(counts) // FILE_IDS))
    fs, place = file_system(folder)
    fs.create_dir(place, recursive=True)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        fs, place = file_system(folder)
        codes, part, rolled = canonical(lengths), TaskContext.get().partitionId(), 0
        keys, cells, held = [], [], 0

        def flush():
            name = f"tokens-{part:06d}-{rolled:04d}.huf"
            commit(fs, place, name, [pack(keys, [len(c) for c in cells], np.concatenate(cells), lengths, codes)])
            return pa.RecordBatch.from_pylist([{"part": part << 20 | rolled, "file": name, "n_ids": held, "n_docs": len(keys)}], pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

        for batch in batches:
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                cells.append(np.frombuffer(cell.as_py(), kind))
                held += len(cells[-1])
                if held >= FILE_IDS:
                    yield flush()
                    keys, cells, held, rolled = [], [], 0, rolled + 1
        if keys:
            yield flush()

    ordered = ids.repartitionByRange(parts, "key").sortWithinPartitions("key", "ids")
    return stored(ordered.mapInArrow(run, "part bigint, file string, n_ids bigint, n_docs bigint"), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str, id_column: str = "doc_id") -> DataFrame:
    """Decode the files of a manifest in parallel: id, start, ids (little-endian u32 bytes).

    ``start`` counts the ids of all documents before it. The driver adds up one number per
    file for that.
    """
    spark = manifest.sparkSession
    files, base = [], 0
    for r in manifest.orderBy("part").collect():
        files.append((r["file"], base))
        base += r["n_ids"]

    def run(batches: Iterator) -> Iterator:
        import posixpath

        import numpy as np
        import pyarrow as pa

        fs, place = file_system(folder)
        tables = {}
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(posixpath.join(place, file)) as stream:
                    keys, sizes, ids = unpack(stream.read(), tables)
                ends = np.cumsum(sizes)
                ids = ids.astype("<u4")
                for at in range(0, len(keys), 512):
                    some = range(at, min(at + 512, len(keys)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([keys[i] for i in some], pa.int64()), pa.array(base + ends[some] - sizes[some], pa.int64()), pa.array([ids[ends[i] - sizes[i] : ends[i]].tobytes() for i in some], pa.binary())],
                        [id_column, "start", "ids"],
                    )

    # One row per file, each in a partition of its own.
    listed = spark.createDataFrame(files, "file string, base bigint").repartition(max(1, len(files)), "file")
    return listed.mapInArrow(run, f"{id_column} bigint, start bigint, ids binary")


def token_digests(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write documents as token files, read them back: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    read = read_tokens(write_tokens(docs, path, end_id, folder), folder)
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
