"""Operator 13: collocations, with phrases counted by Toivonen's sampling.

A sample of the rows proposes phrases: its frequent ones at a lowered threshold, found level
by level. One pass over all rows counts the proposed phrases together with their negative
border, that is every occurring phrase whose first and last words-but-one are both proposed.
A border phrase that turns out frequent is a failure of the sample. A further pass then
counts what contains a failure; it is needed at most once (see :func:`frequent_phrases`).
Passes count 64-bit hashes; the last one counts the phrases themselves, so a collision of
hashes costs time but changes no number.

Tasks know a set of phrases by a Bloom filter of at most 2**FILTER_BITS bits. A false
positive counts a phrase more than needed and leaves every count exact.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, stored

LEAST = 100
LONGEST = 5
TOP = 2000
# One row in SAMPLE proposes phrases, at five eighths of the occurrences expected there.
SAMPLE = 8
FILTER_BITS = 28
RUN_BYTES = 2 << 20
HELD = 2_000_000
TURNS = 2
VOCABULARY = 400_000
MULTIPLIER = 0x9E3779B97F4A7C15
# A-Z in lower case, piece ends as line feeds.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\x0b\x0c\r" else c for c in range(256))


class _Vocabulary(dict):
    """Numbers of words in this task, with their 64-bit hashes by number."""

    def __init__(self):
        import numpy as np

        super().__init__()
        self.hashes = np.zeros(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        import numpy as np
        import xxhash

        at = len(self)
        if at == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[at] = xxhash.xxh64_intdigest(word, 7)
        self[word] = at
        return at


class Filter:
    """A Bloom filter of two bits a hash; ``sent`` is the broadcast of its packed bytes."""

    def __init__(self, sent, bits: int):
        self.sent, self.bits = sent, bits

    def has(self, hashes):
        import numpy as np

        packed = np.frombuffer(self.sent.value, np.uint8)
        out = np.ones(len(hashes), bool)
        for at in (hashes >> np.uint64(64 - self.bits), hashes & np.uint64((1 << self.bits) - 1)):
            out &= ((packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return out


def make_filter(hashes: DataFrame) -> Filter:
    """Filter of the column h; its size grows with the rows up to a fixed bound."""
    import numpy as np

    spark = hashes.sparkSession
    n = hashes.count()
    bits = min(FILTER_BITS, max(16, (16 * n).bit_length()))
    places = F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND(F.lit((1 << bits) - 1)))
    places = hashes.select(F.explode(places).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("v")).toArrow()
    full = np.zeros((1 << bits) // 64, np.uint64)
    full[words["word"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    return Filter(spark.sparkContext.broadcast(full.astype("<u8").tobytes()), bits)


def _parts(text: bytes) -> Iterator[bytes]:
    """The text with its piece ends marked, cut at such ends into parts of about RUN_BYTES."""
    text = text.translate(_BYTES)
    begin = 0
    while len(text) - begin > RUN_BYTES:
        end = text.rfind(b"\n", begin, begin + RUN_BYTES)
        if end < begin:
            end = text.find(b"\n", begin + RUN_BYTES)
        if end < 0:
            break
        yield text[begin:end]
        begin = end + 1
    yield text[begin:]


class Run:
    """Words of several texts in a row, with the hashes of their phrases by length."""

    def __init__(self, parts: list[tuple[str, bytes]], vocabulary: _Vocabulary, longest: int):
        import numpy as np
        import xxhash

        words, lengths, langs = [], [], []
        for lang, part in parts:
            for piece in part.split(b"\n"):
                found = piece.split()
                if found:
                    words += found
                    lengths.append(len(found))
                    langs.append(lang)
        self.vocabulary, self.langs = vocabulary, langs
        self.ids = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
        self.piece = np.repeat(np.arange(len(lengths)), lengths)
        known = {lang: xxhash.xxh64_intdigest(lang.encode(), 11) for lang in set(langs)}
        salt = np.fromiter((known[lang] for lang in langs), np.uint64, len(langs))
        single = vocabulary.hashes[self.ids] ^ salt[self.piece]
        self.hashes, self.whole = [single], [np.ones(len(single), bool)]
        for k in range(2, longest + 1):
            n = max(0, len(single) - k + 1)
            self.hashes.append(self.hashes[-1][:n] * np.uint64(MULTIPLIER) + single[k - 1 :])
            self.whole.append(self.piece[:n] == self.piece[k - 1 :])


def _both(mask, n: int):
    """Where the phrase that begins here and the one that begins a word later both hold."""
    return mask[:n] & mask[1 : n + 1]


def _counted(run: Run, proposed: Filter | None):
    """By length: the places of phrases that the full pass counts (all single words)."""
    out = [run.whole[0]]
    for k in range(1, len(run.hashes)):
        held = out[-1] & proposed.has(run.hashes[k - 1])
        out.append(run.whole[k] & _both(held, len(run.whole[k])))
    return out


def _extended(run: Run, proposed: Filter, frequent: Filter, failed: Filter):
    """By length: the places of uncounted phrases that contain a failure.

    Their words are frequent and so is every part of theirs that the full pass counted.
    """
    import numpy as np

    counted = _counted(run, proposed)
    fine = frequent.has(run.hashes[0])
    holds, out = failed.has(run.hashes[0]), [np.zeros(len(fine), bool)]
    for k in range(1, len(run.hashes)):
        n = len(run.whole[k])
        fine = run.whole[k] & _both(fine, n)
        holds = holds[:n] | holds[1 : n + 1]
        out.append(fine & holds & ~counted[k])
        fine = fine & (~counted[k] | frequent.has(run.hashes[k]))
        holds = holds | failed.has(run.hashes[k])
    return out


def _runs(batches: Iterator, longest: int) -> Iterator[Run]:
    """The rows as runs; the vocabulary is shared until it has grown too large."""
    vocabulary, parts, size = _Vocabulary(), [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for part in _parts(text.as_py() or b""):
                parts.append((lang, part))
                size += len(part)
                if size >= RUN_BYTES:
                    yield Run(parts, vocabulary, longest)
                    parts, size = [], 0
                    if len(vocabulary) > VOCABULARY:
                        vocabulary = _Vocabulary()
    if parts:
        yield Run(parts, vocabulary, longest)


def _count(rows: DataFrame, longest: int, places) -> DataFrame:
    """(h, f): occurrences by hash of the phrases whose places by length ``places(run)`` tells."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, size = [], 0

        def flush():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], ["h", "c"])

        for run in _runs(batches, longest):
            for hashes, mask in zip(run.hashes, places(run)):
                if mask is not None:
                    held.append(hashes[mask])
                    size += len(held[-1])
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("f"))


def _sampled(rows: DataFrame, least: int, longest: int) -> DataFrame:
    """Hashes of the phrases with at least ``least`` occurrences in the rows, level by level."""
    found = stored(_count(rows, 1, lambda run: run.whole).where(F.col("f") >= least), "sampled")
    every = found.select("h")
    for size in range(2, longest + 1):
        if found.isEmpty():
            break
        last = make_filter(found)

        def places(run: Run, size=size, last=last):
            held = last.has(run.hashes[size - 2])
            return [None] * (size - 1) + [run.whole[size - 1] & _both(held, len(run.whole[size - 1]))]

        found = stored(_count(rows, size, places).where(F.col("f") >= least), "sampled")
        every = every.unionByName(found.select("h"))
    return every


class _Spelling:
    """Counts of this task's phrases as arrays: hash, words by number, size, lang and count."""

    def __init__(self, longest: int):
        self.longest, self.parts, self.size, self.langs, self.odd = longest, [], 0, {}, []

    def add(self, run: Run, at, k: int):
        """The phrases of k + 1 words at the places ``at``."""
        import numpy as np

        hashes, first, which, times = np.unique(run.hashes[k][at], return_index=True, return_inverse=True, return_counts=True)
        words = np.full((len(at), self.longest), -1, np.int32)
        for j in range(k + 1):
            words[:, j] = run.ids[at + j]
        code = np.fromiter((self.langs.setdefault(lang, len(self.langs)) for lang in run.langs), np.int32, len(run.langs))[run.piece[at]]
        if len(first) < len(at):
            same = (words == words[first][which]).all(axis=1) & (code == code[first][which])
            if not same.all():
                self.odd += [(tuple(words[i]), int(code[i]), 1) for i in np.flatnonzero(~same)]
                times = np.bincount(which[same], minlength=len(first))
        self.parts.append((hashes, words[first], code[first], times))
        self.size += len(hashes)

    def merge(self):
        """Add up what the parts have in common; phrases of one hash that differ are set apart."""
        import numpy as np

        hashes, words, code, times = (np.concatenate(x) for x in zip(*self.parts))
        hashes, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        same = (words == words[first][which]).all(axis=1) & (code == code[first][which])
        self.odd += [(tuple(words[i]), int(code[i]), int(times[i])) for i in np.flatnonzero(~same)]
        times = np.bincount(which[same], times[same], len(first)).astype(np.int64)
        self.parts, self.size = [(hashes, words[first], code[first], times)], len(first)

    def move(self, old: _Vocabulary, new: _Vocabulary) -> bool:
        """Number the words by another vocabulary, unless they are too many to carry over."""
        import numpy as np

        if self.parts:
            self.merge()
        odd = np.array([words for words, _, _ in self.odd], np.int32).reshape(-1, self.longest)
        used = np.unique(np.concatenate([words.ravel() for _, words, _, _ in self.parts] + [odd.ravel()]))
        used = used[used >= 0]
        if len(used) > VOCABULARY // 2:
            return False
        spelled = list(old)
        # The last place is that of -1, no word.
        numbers = np.full(len(spelled) + 1, -1, np.int32)
        numbers[used] = [new[spelled[w]] for w in used.tolist()]
        self.parts = [(hashes, numbers[words], code, times) for hashes, words, code, times in self.parts]
        self.odd = [(tuple(words), code, n) for words, (_, code, n) in zip(numbers[odd].tolist(), self.odd)]
        return True

    def batches(self, vocabulary: _Vocabulary) -> Iterator:
        import pyarrow as pa

        if self.parts:
            self.merge()
            _, words, code, times = self.parts[0]
            self.odd += zip(words.tolist(), code.tolist(), times.tolist())
        spelled, langs = list(vocabulary), list(self.langs)
        for i in range(0, len(self.odd), 10_000):
            some = self.odd[i : i + 10_000]
            phrases = [[spelled[w] for w in words if w >= 0] for words, _, _ in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([langs[c] for _, c, _ in some], pa.string()), pa.array(list(map(len, phrases)), pa.int32()),
                    pa.array([b" ".join(p) for p in phrases], pa.binary()), pa.array([n for _, _, n in some], pa.int64()),
                ],
                ["lang", "size", "phrase", "c"],
            )
        self.parts, self.size, self.odd = [], 0, []


def _spellings(rows: DataFrame, longest: int, frequent: Filter) -> DataFrame:
    """(lang, size, phrase, c): each task's counts of all phrases in the filter; size 0 counts the words of a lang.

    A task tells nearly all frequent phrases however few rows it reads, so the pass takes
    TURNS tasks a slot and not one for every piece of the input. Counts go along when a task
    begins a new vocabulary, so it tells a phrase once, unless it holds more than HELD of them.
    """

    def spell(batches: Iterator) -> Iterator:
        import collections

        import numpy as np
        import pyarrow as pa

        held, words, vocabulary = _Spelling(longest), collections.Counter(), None
        for run in _runs(batches, longest):
            if vocabulary is not None and (held.size > HELD or run.vocabulary is not vocabulary and not held.move(vocabulary, run.vocabulary)):
                yield from held.batches(vocabulary)
            vocabulary = run.vocabulary
            for lang, n in zip(run.langs, np.bincount(run.piece, minlength=len(run.langs)).tolist()):
                words[lang] += n
            known = None
            for k, hashes in enumerate(run.hashes):
                places = run.whole[k] if known is None else run.whole[k] & _both(known, len(run.whole[k]))
                known = places & frequent.has(hashes)
                at = np.flatnonzero(known)
                if not len(at):
                    break
                held.add(run, at, k)
            if held.size > HELD // 4:
                held.merge()
        if vocabulary is not None:
            yield from held.batches(vocabulary)
        if words:
            n = len(words)
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array([0] * n, pa.int32()), pa.array([b""] * n, pa.binary()), pa.array(list(words.values()), pa.int64())], ["lang", "size", "phrase", "c"])

    some = rows.coalesce(TURNS * rows.sparkSession.sparkContext.defaultParallelism)
    return some.mapInArrow(spell, "lang string, size int, phrase binary, c bigint")


def _spelled(rows: DataFrame, longest: int, frequent: Filter) -> DataFrame:
    """(lang, size, phrase, f) of all phrases in the filter; size 0 counts the words of a lang."""
    return _spellings(rows, longest, frequent).groupBy("lang", "size", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("c").alias("f"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE) -> DataFrame:
    """(lang, size, phrase, f) of all phrases of up to ``longest`` words with f >= ``least``.

    ``docs`` has doc_id, text and lang. Rows of size 0 hold the number of all words of a lang.
    Null texts have no words, a null lang is ``und``; repeated rows count as often as they occur.

    Why one further pass closes the search: a frequent phrase that the full pass left out has a
    frequent part that was counted and not proposed, a failure, and all its parts are
    frequent; the further pass counts all phrases of that kind.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lang = F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang")
    rows = docs.select(lang, docs["text"].cast("binary").alias("text"), F.pmod(F.xxhash64(docs["doc_id"], docs["text"]), F.lit(sample)).alias("part"))
    some = stored(rows.where("part = 0").select("lang", "text"), "sample")
    rows = rows.select("lang", "text")
    proposed = make_filter(_sampled(some, max(2, 5 * least // (8 * sample)), longest))
    counts = stored(_count(rows, longest, lambda run: _counted(run, proposed)).where(F.col("f") >= least), "counts")
    known = _mark(counts, proposed)
    failures = known.where("not proposed").select("h")
    frequent = make_filter(counts)
    if not failures.isEmpty():
        failed, words = make_filter(failures), frequent
        more = _count(rows, longest, lambda run: _extended(run, proposed, words, failed)).where(F.col("f") >= least)
        frequent = make_filter(counts.unionByName(stored(more, "counts")))
    return _spelled(rows, longest, frequent).where((F.col("size") == 0) | (F.col("f") >= least))


def _mark(counts: DataFrame, proposed) -> DataFrame:
    """Adds whether the filter that the full pass used knows the phrase."""

    def mark(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(proposed.has(batch.column(0).to_numpy().view(np.uint64)))], ["h", "proposed"])

    return counts.select("h").mapInArrow(mark, "h bigint, proposed boolean")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each lang by score.

    A phrase scores floor(1000 a n / (l r)) at its worst cut (ties: the earliest). Phrases inside a
    longer one that is as frequent are left out. An empty table and a lang without
    frequent phrases yield no rows.
    """
    found = stored(frequent_phrases(docs, least, longest, sample), "phrases")
    totals = found.where("size = 0").select("lang", F.col("f").alias("n"))
    phrases = found.where("size > 0").select("lang", "phrase", F.col("f"))
    candidates = found.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: F.array_join(F.slice(words, s, m), " "))))
    covered = candidates.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ones = candidates.join(covered, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    cut = open_ones.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), words.alias("w"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    whole = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    # Up to 38 digits; the quotient is at most 1000 n.
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")).cast("decimal(34,0)"), wide("l") * wide("r"))
    worst = whole.withColumn("score", score.cast("bigint")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = worst.select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
