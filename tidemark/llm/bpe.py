"""Operator 5: byte-level BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word exactly one token can end the prefix's BPE encoding. An
automaton over the vocabulary reports the tokens that are suffixes of a prefix; the one
that fits is the one compatible with the last token of what stands before it. Following
the stored tokens back from the end gives the exact ids in time linear in the word's
length, for words of any length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .shared import small_batches

# Fixed value: the split pattern of byte-level BPE.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 500_000
CACHED_CHARS = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files, as letter to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class _Cache(dict):
    """Ids by word, up to a bound: words that are frequent are met early and stay.

    Long words with a stop or comma are put together from the bare word instead.
    """

    def __init__(self, fill):
        super().__init__()
        self.fill = fill

    def __missing__(self, word):
        value = self.fill(word)
        if len(word) <= CACHED_CHARS and len(self) < CACHE_WORDS and not (len(word) > 6 and word[-1] in ",."):
            self[word] = value
        return value


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer") or model.get("dropout"):
            raise ValueError(f"{path} is not a byte-level BPE file")
        vocab = model["vocab"]
        raw = {t: bytes(map(letters.__getitem__, t)) for t in vocab}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for t, i in vocab.items():
            self.token[i] = raw[t]
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.size = list(map(len, self.token))
        # born: rank of the merge that makes a token (single bytes: -1); halves: its two parts.
        self.rank, self.born, self.halves = {}, [-1] * size, [None] * size
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.rank.setdefault((a, b), rank)
            if self.halves[made] is None:
                self.born[made], self.halves[made] = rank, (a, b)
        self.suffixes = ahocorasick.Automaton()
        for t, i in vocab.items():
            if len(raw[t]) == 1 or self.halves[i]:
                self.suffixes.add_word(raw[t].decode("latin-1"), i)
        self.suffixes.make_automaton()
        self.fits = {}
        self.split = regex.compile(SPLIT).findall
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.prefix = bool(spec["pre_tokenizer"].get("add_prefix_space"))
        self.words, self.pieces = _Cache(self._word), _Cache(self._piece)

    def compatible(self, a: int, b: int) -> bool:
        """Does BPE leave token a followed by token b as they are?

        Walk back in time through the symbols that met at the border: those at the right
        edge of a and the left edge of b. A merge across it happens if its rank comes
        before the merges that took either symbol away; of equal merges the left one is
        first.
        """
        rank, born, halves = self.rank, self.born, self.halves
        ends_a = ends_b = len(rank) + 1
        while True:
            across = rank.get((a, b))
            if across is not None and across < ends_a and across <= ends_b:
                return False
            if born[a] < 0 and born[b] < 0:
                return True
            if born[a] > born[b]:
                ends_a, a = born[a], halves[a][1]
            else:
                ends_b, b = born[b], halves[b][0]

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of one word of the split pattern."""
        text = word.encode("utf-8", "surrogatepass").decode("latin-1")
        last, sizes, fits = [-1] * (len(text) + 1), self.size, self.fits
        for end, token in self.suffixes.iter(text):
            end += 1
            if last[end] < 0:
                start = end - sizes[token]
                if start:
                    before = last[start]
                    known = fits.get(before << 20 | token)
                    if known is None:
                        if len(fits) >= CACHE_WORDS:
                            fits.clear()
                        known = fits[before << 20 | token] = self.compatible(before, token)
                    if known:
                        last[end] = token
                else:
                    last[end] = token
        at = len(text)
        if last[at] >= 0 and sizes[last[at]] == at:
            return (last[at],)
        ids = []
        while at:
            ids.append(last[at])
            at -= sizes[last[at]]
        return tuple(reversed(ids))

    def _piece(self, piece: str) -> tuple[int, ...] | None:
        """Ids of a space and the text up to the next one; None if white space touches its ends."""
        if piece.isalpha():
            return self._word(" " + piece)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        if piece[-1] in ",." and piece[:-1].isalpha():
            return self.pieces[piece[:-1]] + self.words[piece[-1]]
        return tuple(i for word in self.split(" " + piece) for i in self.words[word])

    def _ordinary(self, text: str) -> list[int]:
        # No word of the pattern has a space after another character, so texts fall apart
        # before single spaces; around runs of white space the whole text is split.
        first, _, rest = text.partition(" ")
        if rest and first and not first[-1].isspace():
            found = list(map(self.pieces.__getitem__, rest.split(" ")))
            if None not in found:
                ids = [i for word in self.split(first) for i in self.words[word]]
                for piece in found:
                    ids += piece
                return ids
        return [i for word in self.split(text) for i in self.words[word]]

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of special tokens become their ids."""
        if not self.special or not any(s in text for s in self.special):
            return self._ordinary(text) if text else []
        ids, at = [], 0
        for m in self.apart.finditer(text):
            ids += self._ordinary(text[at : m.start()]) if m.start() > at else []
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + (self._ordinary(text[at:]) if at < len(text) else [])

    def decode(self, ids) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """One encoder per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every text: id column, n_tokens, ids.

    Null and empty texts have no ids. Rows are handled one by one: repeated rows give
    repeated rows, an empty table an empty one; other columns do not take part.
    """
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_column].alias("key"), docs[text_column].alias("body"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = tokenizer(path)
        for batch in batches:
            ids = [bpe.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["key", "n_tokens", "ids"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens bigint, ids array<int>").withColumnRenamed("key", id_column)


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every text, decode the ids, and keep digests of both.

    Returns the id column, n_tokens, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256 (decoded text in UTF-8). Null counts as empty text. Ids never leave the
    task, so nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_column].alias("key"), docs[text_column].alias("body"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe, sha = tokenizer(path), hashlib.sha256
        digits = list(map(str, range(len(bpe.token))))
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                rows.append((len(ids), sha(",".join(map(digits.__getitem__, ids)).encode()).hexdigest(), sha(bpe.decode(ids).encode()).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", id_column)
