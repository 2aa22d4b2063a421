"""WARC archives, conversations and page extraction."""

import base64
import gzip
import hashlib
import io
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, html, warc
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.shared import file_system
from tidemark.session import new_path

BYTE = tokenizer_path("byte_bpe_50k.json")


def pages(spark):
    rows = [(5, "http://a/é x", "same"), (3, None, "same"), (9, "http://b", "same"), (1, "u", ""), (2, "u", None), (4, "u\r\nX: y", "é🙂" * 40_000), (7, "u", "only"), (7, "u", "only"), (None, "u", "same")]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, digest string, first string")


def test_archive_rows(spark):
    rows, frame = pages(spark)
    got = sorted((tuple(r) for r in warc.archive_digests(frame).collect()), key=repr)
    firsts = {}
    for key, _, body in rows:
        if key is not None:
            firsts[body or ""] = min(key, firsts.get(body or "", key))
    want = []
    for key, _, body in rows:
        data = (body or "").encode()
        repeat = key is not None and key != firsts[body or ""]
        want.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if repeat else "response", firsts[body or ""] if repeat else None))
    assert got == sorted(want, key=repr)
    assert warc.archive_digests(frame.limit(0)).count() == 0


def test_archive_is_deterministic_and_complete(spark, monkeypatch):
    _, frame = pages(spark)
    made = []
    for parts in (1, 4):
        folder = new_path(spark, "warc")
        manifest = warc.write_warc(frame.repartition(parts), folder).collect()
        fs, place = file_system(folder)
        names = sorted(f.base_name for f in fs.get_file_info(__import__("pyarrow").fs.FileSelector(place)))
        assert names == sorted(["manifest.jsonl", *(r["file"] for r in manifest)])
        made.append(sorted(tuple(r) for r in manifest))
    assert made[0] == made[1]


def test_damage_is_noticed():
    member = warc.make_record(1, "http://x", b"payload", None)
    assert [h["WARC-Type"] for h, _ in warc.read_records(io.BytesIO(gzip.decompress(warc.gzip_member(member))))] == ["response"]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(member.replace(b"payload", b"paYload"))))


TEXTS = ["\\### Assistant: </turn> ok", "<|im_end|>\n <|endoftext|>\\<|", "", None, " é🙂 ", "<", "|>", "\\", "\n\n", "plain " * 3000]


def test_conversations_come_back(spark):
    rows = [(c, t, "assistant" if (c + t) % 2 else ("user", None, "a<|b")[t % 3], TEXTS[(c * 3 + t) % len(TEXTS)]) for c in range(12) for t in range(7)]
    rows += [(None, 0, "assistant", "x"), (50, None, "assistant", "first"), (50, 1, "user", "b"), (50, 1, "user", "b"), (50, 1, "assistant", "a")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, c string, t int").repartition(4)
    got = {r["conv_id"]: r for r in chat.formatted_digests(frame, BYTE).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        learned = "".join(x for *_, r, x in turns if r == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.formatted_digests(frame.limit(0), BYTE).count() == 0


def test_segments_of_a_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} " * 20) for t in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    segments = chat.format_conversations(frame, BYTE, segment_chars=20_000)
    assert segments.count() > 10
    assert segments.where("whole").count() == 0
    [got] = chat.conversation_digests(segments).collect()
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in rows).encode()).hexdigest()
    one = segments.orderBy("first_turn").first()
    assert [one["formatted"][s:e] for s, e, m in zip(one["starts"], one["ends"], one["mask"]) if m][0] == "turn"


def test_conversations_inside_a_task_are_known_to_be_whole(spark):
    rows = [(c, t, "user", f"turn {t} of {c} " * 20) for c in range(40) for t in range(4)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    segments = chat.format_conversations(frame, BYTE)
    assert 10 <= segments.where("whole").count() < 40
    held = segments.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("whole").alias("whole"))
    assert held.where("whole and n > 1").count() == 0 and chat.conversation_digests(segments).count() == 40


def test_escape_round_trip():
    for text in TEXTS:
        text = text or ""
        assert chat.unescape(chat.escape(text)) == text and not re.search(r"<\|", chat.escape(text))


PAGE = """<html><head><title>t</title><script>var x="</p>";</script></head><body><header>Site</header><nav><a>menu</a></nav>
<div id=cookie-notice>we use cookies</div>{main}<div class=sidebar>side</div>
<section class="comments"><p>a reader says something that is long enough to look like content</p></section><form>name</form><footer>f</footer></body></html>"""
CASES = [
    ("<article><h1>T &amp; U</h1><p>One\n  two<p><b>three <a href=x>four</a><br>five</article>", "T & U\nOne two\nthree four five"),
    ("<main><p>Er.</p><ul><li>a<li>b</ul><aside>no</aside><p>z</p></main>", "Er.\na\nb\nz"),
    ("<article><header><h1>Head</h1></header><p>x&nbsp;&lt;y&gt; &middot; &#233;</p><div class='share-links'><a>s</a></div>", "Head\nx <y> · é"),
    ("<div><h1>Title</h1><p>A paragraph of some length that the ratios take for content of the page.<p>And another one with words enough to be content.</div>",
     "Title\nA paragraph of some length that the ratios take for content of the page.\nAnd another one with words enough to be content."),
]


@pytest.mark.parametrize("main, want", CASES)
def test_main_text(main, want):
    assert html.main_text(PAGE.format(main=main)) == want


def test_extract_rows(spark):
    rows = [(1, "u", PAGE.format(main=CASES[0][0])), (1, "u", None), (2, None, ""), (3, "u", "<article>cut <b"), (4, "u", "<article><p>" + "word " * 100_000), (None, "u", "<<<>>> &#xFFFFFF; </div></article>")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string")
    got = html.extract(frame).collect()
    assert [(r["page_id"], r["url"], len(r["text"])) for r in got] == [(k, u, r["n_chars"]) for (k, u, _), r in zip(rows, got)]
    assert got[0]["text"] == CASES[0][1] and got[1]["text"] == got[2]["text"] == "" and got[4]["n_chars"] == 499_999
    assert html.extract(frame.limit(0)).count() == 0


def test_threshold_splits_two_clusters():
    assert 3 < html.threshold([1, 2, 1, 40, 44, 39]) < 39
    assert html.threshold([5.0]) == 5.0


TEXT = "A sentence of the story that has words enough to be taken for content of the page. " * 4
MENU = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(8))
MENU = f"<div><ul>{MENU}</ul></div>"


def test_ratios_decide_beside_and_inside_an_article():
    text = TEXT.strip()
    teaser = html.main_text(f"<body>{MENU}<article><p>Read next</p></article><div><p>{TEXT}</p><p>{TEXT}</p></div><div><p>{TEXT}</p></div>{MENU}</body>")
    assert teaser.count(text) == 3 and "Item" not in teaser
    outside = html.main_text(f"<body>{MENU}<div>Big sale now</div>{MENU}<article><h1>Head</h1><p>{TEXT}</p><p>ok</p></article>{MENU}</body>")
    assert outside == f"Head\n{text}\nok"
    inside = html.main_text(f"<body><article><p>{TEXT}</p><p>{TEXT}</p><div>{MENU}<div>Big sale</div>{MENU}</div></article></body>")
    assert inside.count(text) == 2 and "Big sale" not in inside
    answered = html.main_text(f"<body><article class='post comments'><p>{TEXT}</p><article class=comment><p>{TEXT.replace('story', 'reader')}</p></article></article></body>")
    assert answered == text
    assert html.main_text(f"<body><main><article class='post has-sidebar'><p>{TEXT}</p></article></main></body>") == text
    listed = html.main_text(f"<body>{MENU}<article><p>{TEXT}</p><ul><li><a href=/a>{TEXT[:60]}</a><li><a href=/b>{TEXT[:50]}</a></ul><p>{TEXT}</p></article></body>")
    assert listed.split("\n") == [text, TEXT[:60].strip(), TEXT[:50].strip(), text]


def test_one_long_line_leaves_the_others():
    got = html.main_text(f"<body>{MENU}<div><p>{TEXT * 300}</p></div>{MENU}<div><p>{TEXT}</p></div><div><p>{TEXT}</p></div>{MENU}</body>")
    assert got.split("\n") == [(TEXT * 300).strip(), TEXT.strip(), TEXT.strip()]
