"""Operator 9: conversations as training text with a loss mask aligned by token offsets.

A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``. The three markers are special
tokens, so no token crosses the border of a text. Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, which no marker holds; both are undone on reading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, stored

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.S)
# A batch of 512 segments with their offsets stays under 100 MB, but for turns that are longer.
SEGMENT_CHARS = 1 << 15
# Segments whose tokens and offsets a worker holds at once.
ENCODED_AT_ONCE = 32
LEARNED_ROLE = "assistant"
_loaded: dict = {}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """Text of (role, text) turns and the sorted spans of the learned texts in it."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = START + escape(role) + SEPARATOR, escape(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


def loss_mask(spans, starts, ends):
    """Which tokens lie in a span: both lists are sorted, so two binary searches tell."""
    import numpy as np

    mask = np.zeros(len(starts), bool)
    if len(spans):
        low, high = np.array(spans).T
        first, last = np.searchsorted(starts, low, "left"), np.searchsorted(ends, high, "right")
        for a, b in zip(first, last):
            mask[a:b] = True
    return mask


def tokenizer(path: str):
    """The vocabulary with the three markers as special tokens; one per Python worker."""
    from tokenizers import Tokenizer

    if path not in _loaded:
        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        made.add_special_tokens([START, SEPARATOR, END])
        _loaded[path] = made
    return _loaded[path]


def format_conversations(rows: DataFrame, path: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Segments of conversations: conv, first_turn, part, whole, formatted, ids, starts, ends, mask.

    Turns are ordered by turn, equal ones by role and text; null roles and texts count as
    empty. A segment holds whole turns of one conversation, all of them unless it
    has over ``segment_chars`` characters or lies on the border of two tasks; markers separate
    turns, so its tokens are those of the whole; ``whole`` tells that a segment is known to
    hold all of its conversation. Rows are dealt by (conv, turn) ranges:
    a conversation with a third of all turns is spread over tasks. Repeated rows are
    turns of their own, a null conversation is one too. Other columns do not take part.
    """
    small_batches(rows.sparkSession)
    source = rows.select(rows[conv].alias("c"), rows[turn].cast("bigint").alias("t"), F.coalesce(rows[role], F.lit("")).alias("role"), F.coalesce(rows[text], F.lit("")).alias("text"))
    ordered = source.repartitionByRange("c", "t").sortWithinPartitions("c", "t", "role", "text")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe = tokenizer(path)
        kind, part, done = None, 0, []
        now, first, turns, size = None, None, [], 0

        def encoded():
            rendered = [render(s[3]) for s in done]
            found = bpe.encode_batch([r[0] for r in rendered], add_special_tokens=False)
            cells = []
            for (_, spans), e in zip(rendered, found):
                offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
                cells.append((offsets[:, 0], offsets[:, 1], loss_mask(spans, offsets[:, 0], offsets[:, 1])))
            columns = [
                pa.array([s[0] for s in done], kind), pa.array([s[1] for s in done], pa.int64()), pa.array([s[2] for s in done], pa.int64()), pa.array([s[4] for s in done], pa.bool_()),
                pa.array([r[0] for r in rendered]), pa.array([e.ids for e in found], pa.list_(pa.int32())),
                pa.array([c[0] for c in cells], pa.list_(pa.int32())), pa.array([c[1] for c in cells], pa.list_(pa.int32())), pa.array([c[2] for c in cells], pa.list_(pa.bool_())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["c", "first_turn", "part", "whole", "formatted", "ids", "starts", "ends", "mask"])

        # The first and the last conversation of a task may go on in another one.
        waiting, inside = 0, False
        for batch in batches:
            kind = batch.schema.field(0).type
            for c, t, r, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if turns and (c != now or size > segment_chars):
                    done.append((now, first, part, turns, inside and c != now))
                    inside = c != now
                    part, turns, waiting, size = part + 1, [], waiting + size, 0
                    if len(done) >= ENCODED_AT_ONCE or waiting > segment_chars:
                        yield encoded()
                        done, waiting = [], 0
                if not turns:
                    now, first = c, t
                turns.append((r, x))
                size += len(x)
        if turns:
            done.append((now, first, part, turns, False))
        if done:
            yield encoded()

    key = source.schema["c"].dataType.simpleString()
    schema = f"c {key}, first_turn bigint, part bigint, whole boolean, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"
    return ordered.mapInArrow(run, schema).withColumnRenamed("c", conv)


COUNTED = "n_turns bigint, turns binary, loss_chars bigint, loss binary, formatted_chars bigint"


def _read_back(segments: DataFrame) -> DataFrame:
    """What every segment holds, read where it lies; of whole conversations the digests in place of the texts.

    Turns are parsed out of the formatted strings, the learned text out of the masked token spans.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i, whole in enumerate(batch.column(3).to_pylist()):
                formatted = batch.column(4)[i].as_py()
                turns = parse(formatted)
                text = "".join(f"{role}\n{text}\n" for role, text in turns).encode()
                starts, ends, mask = (np.array(batch.column(j)[i].values) for j in (5, 6, 7))
                edges = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
                spans = zip(starts[np.flatnonzero(edges == 1)].tolist(), ends[np.flatnonzero(edges == -1) - 1].tolist())
                learned = "".join(unescape(formatted[a:b]) for a, b in spans)
                held = [text, learned.encode()]
                if whole:
                    held = [hashlib.sha256(h).digest() for h in held]
                rows.append((len(turns), held[0], len(learned), held[1], len(formatted)))
            types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
            cells = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, t) for c, t in zip(cells, types))], ["c", "first_turn", "part", "whole", "n_turns", "turns", "loss_chars", "loss", "formatted_chars"])

    key = segments.schema["c"].dataType.simpleString()
    return segments.mapInArrow(run, f"c {key}, first_turn bigint, part bigint, whole boolean, {COUNTED}")


def conversation_digests(segments: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the segments hold, read back: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Segments are read where they lie. Only the texts of conversations in several segments are
    shuffled, and a task goes through them one after the other and keeps running hashes.
    """
    pieces = _read_back(segments.select(segments[conv].alias("c"), "first_turn", "part", "whole", "formatted", "starts", "ends", "mask"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, kind, out, state = None, None, [], None

        def result():
            return now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        def table(rows):
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind = batch.schema.field(0).type
            names = ("whole", "n_turns", "loss_chars", "formatted_chars")
            whole, n_turns, loss_chars, chars = (batch.column(name).to_pylist() for name in names)
            for i, c in enumerate(batch.column("c").to_pylist()):
                turns, loss = batch.column("turns")[i].as_py(), batch.column("loss")[i].as_py()
                if whole[i]:
                    out.append((c, n_turns[i], turns.hex(), loss_chars[i], loss.hex(), chars[i]))
                    continue
                if state is None or c != now:
                    if state:
                        out.append(result())
                    now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n_turns[i]
                state[1].update(turns)
                state[2] += loss_chars[i]
                state[3].update(loss)
                state[4] += chars[i]
            if len(out) >= 512:
                yield table(out)
                out = []
        if state:
            out.append(result())
        if out:
            yield table(out)

    key = pieces.schema["c"].dataType.simpleString()
    dealt = pieces.repartition("c").sortWithinPartitions("c", "first_turn", "part")
    return dealt.mapInArrow(run, f"c {key}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").withColumnRenamed("c", conv)


def formatted_digests(rows: DataFrame, path: str) -> DataFrame:
    """Format, store, read back: one row per conversation."""
    return conversation_digests(stored(format_conversations(rows, path), "chat", "zstd"))
