"""BPE and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from odd import odd_documents
from tokenizers import Tokenizer

from tidemark.llm import bpe, token_files
from tidemark.llm.queries import tokenizer_path
from tidemark.session import new_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
TEXTS = [
    "don't we'll I'M é x  \n y\t", "<|endoftext|>x <|endoftext|>", "日本語 🙂🙂 👩‍👩‍👧", "\x1c a \x1fb", " lead", "\n\nx", "x\n \ny", "１２３ ½ ⅷ",
    "!!!???...---===", "a" * 500, "ab" * 300 + "   ", "　 　x", "é É ﬁ İ", "<|startoftext|> b",
]


def noise(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abtheing  \n'sé1# 🙂") for _ in range(r.randint(1, 80))) for _ in range(n)]


def test_bpe_ids_are_the_librarys():
    own, library = bpe.ByteBpe(BYTE), Tokenizer.from_file(BYTE)
    for text in [*TEXTS, *noise(300), ""]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_cut_characters_decodes_as_the_library():
    own, library = bpe.ByteBpe(BYTE), Tokenizer.from_file(BYTE)
    ids = own.encode("🙂é日")
    for cut in range(len(ids)):
        assert own.decode(ids[cut:]) == library.decode(ids[cut:], skip_special_tokens=False)


def test_every_token_is_its_own_encoding():
    own = bpe.ByteBpe(BYTE)
    whole = [i for i, t in enumerate(own.token[:50256]) if own.halves[i] is not None]
    for i in random.Random(2).sample(whole, 3000):
        left, right = own.halves[i]
        assert own.rank[left, right] == own.born[i]
        assert not own.compatible(left, right)


def test_round_trip_rows(spark):
    rows, docs = odd_documents(spark, TEXTS)
    library = Tokenizer.from_file(BYTE)
    got = sorted((tuple(r) for r in bpe.round_trip(docs, BYTE).collect()), key=repr)
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(docs, BYTE).collect()}
    assert ids[900] == [] and ids[2] == library.encode(TEXTS[2], add_special_tokens=False).ids
    assert bpe.round_trip(docs.limit(0), BYTE).count() == 0


def test_code_lengths_are_optimal_and_limited():
    import heapq

    counts = np.random.default_rng(0).integers(0, 5000, 700) ** 2
    lengths = token_files.code_lengths(counts, 40)
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        best += a + b
        heapq.heappush(heap, a + b)
    assert (lengths.astype(int) * counts).sum() == best
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    limited = token_files.code_lengths(fibonacci, 8)
    assert limited.max() == 8 and sum(2.0 ** -int(n) for n in limited) == 1.0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("symbols", [1, 2, 3000])
def test_packed_ids_come_back(n, symbols):
    ids = np.random.default_rng(n).integers(0, symbols, n)
    lengths = token_files.code_lengths(np.bincount(np.append(ids, symbols - 1), minlength=symbols))
    data = token_files.pack([7, None], [n, 0], ids, lengths, token_files.canonical(lengths))
    keys, sizes, out = token_files.unpack(data)
    assert keys == [7, None] and list(sizes) == [n, 0] and (out == ids).all()
    if n:
        with pytest.raises(ValueError):
            token_files.unpack(data[:-3])


def test_token_files_rows(spark, monkeypatch):
    rows, docs = odd_documents(spark, TEXTS)
    library = Tokenizer.from_file(WORD)
    got = sorted((tuple(r) for r in token_files.token_digests(docs, WORD, 2).collect()), key=lambda r: r[1])
    cells = [(key is not None, key or 0, np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")) for key, text in rows]
    start, want = 0, []
    for known, key, ids in sorted(cells, key=lambda c: c[:2]):
        want.append((key if known else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.token_digests(docs.limit(0), WORD).count() == 0


def test_token_files_roll_and_keep_order(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 300)
    docs = spark.createDataFrame([(i * 3 % 101, f"the end of text {i} " * (i % 7)) for i in range(101)], "doc_id bigint, text string").repartition(5)
    folder = new_path(spark, "rolled")
    manifest = token_files.write_tokens(docs, WORD, 2, folder)
    assert manifest.count() > 3
    rows = token_files.read_tokens(manifest, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(i * 3 % 101 for i in range(101))
    ends = [r["start"] + len(r["ids"]) // 4 for r in rows]
    assert [r["start"] for r in rows] == [0, *ends[:-1]]


def test_only_vocabularies_whose_words_stand_alone_are_taken_apart(tmp_path):
    """Case and stops are dropped only where the file says so; others are encoded as whole texts."""
    import json

    assert token_files.splits_at_blanks(WORD) and not token_files.splits_at_blanks(BYTE)
    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    steps = spec["normalizer"]["normalizers"]
    changes = {"normalizer": {"type": "Sequence", "normalizers": steps[:2]}, "pre_tokenizer": {"type": "Whitespace"}}
    for name, value in changes.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(spec | {name: value}), encoding="utf-8")
        assert not token_files.splits_at_blanks(str(path))


def test_words_are_encoded_as_in_their_text(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 6)
    library, words = Tokenizer.from_file(WORD), token_files._Words(WORD, "<u4")
    texts = [*(t or "" for t in TEXTS), "It's THE end. The End, it's... e\u0301 a\tb\r\nC <|endoftext|> x<|endoftext|>. 12a, ., ,", "The end, again."] * 2
    for text, ids in zip(texts, words.texts(texts)):
        assert ids == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(words) == 6


def test_words_of_letters_need_the_model_alone():
    library, words = Tokenizer.from_file(WORD), token_files._Words(WORD, "<u2")
    letters = [chr(c) for c in (*range(0x250), 0x1E9E, 0x212B) if chr(c).isalpha() and chr(c).lower() < "\u0250"]
    pieces = [p for c in letters for p in (c, f"a{c}b", f"Q{c}x!?", f"{c}z***")]
    seen = []

    class Spy:
        def encode(self, text, **how):
            seen.append(text)
            return library.encode(text, **how)

    words.tokenizer = Spy()
    for piece, ids in zip(pieces, words.texts(pieces)):
        assert ids == np.array(library.encode(piece, add_special_tokens=False).ids, "<u2").tobytes()
    assert {c for text in seen for c in text if c.isalpha()} <= set("aQbxz\u0130\u1e9e\u212b")
