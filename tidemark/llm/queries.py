"""One registered query per operator of this package, over whole tables, and SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, grid, html, lines, phrases, quality, simhash, token_files, toxicity, warc, whiten
from .shared import table

QUERIES = {}
ORACLES = {}


def tokenizer_path(name: str) -> str:
    """A vocabulary file, in the folder TOKENIZER_DIR names or the installed package's."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_html")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (SELECT x, min(y) AS y FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.y, vec_id)) AS component_id,
  vec_id <= coalesce(c.y, vec_id) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.x LEFT JOIN n ON vec_id = n.x
"""


@query("op2_vectors", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op3_warc")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(table(spark, sf_dir, "pages"))


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


# Pairs at edit distance 1 share the left or the right half of the shorter line.
OP8_SQL = """
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL
), k AS (SELECT DISTINCT line, length(line) AS n FROM l WHERE length(line) >= 20),
h AS (
  SELECT line, n, c, 'left' AS side, left(line, c // 2) AS half FROM (SELECT line, n, unnest([n, n - 1]) AS c FROM k)
  UNION ALL SELECT line, n, c, 'right', right(line, c - c // 2) FROM (SELECT line, n, unnest([n, n - 1]) AS c FROM k)
), p AS (
  SELECT DISTINCT a.line AS a, b.line AS b FROM h a JOIN h b ON a.c = b.c AND a.side = b.side AND a.half = b.half AND a.n = a.c AND a.line <> b.line
), e AS (
  SELECT a, b FROM p WHERE CASE WHEN length(a) = length(b) THEN len([i FOR i IN range(1, length(a) + 1) IF a[i] <> b[i]]) <= 1
    ELSE len([i FOR i IN range(0, length(b)) IF left(b, i) || substr(b, i + 2) = a]) > 0 END
), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a),
c AS (SELECT a AS line, least(a, min(b)) AS class FROM r GROUP BY a),
o AS (SELECT doc_id, pos, l.line, length(l.line) >= 20 AS long, coalesce(class, l.line) AS class FROM l LEFT JOIN c ON l.line = c.line),
f AS (
  SELECT *, long AND row_number() OVER w > 1 AS gone, first_value(doc_id) OVER w AS first_doc FROM o WINDOW w AS (PARTITION BY long, class ORDER BY doc_id, pos)
), g AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    min(first_doc) FILTER (WHERE gone) AS class_id, count(DISTINCT first_doc) FILTER (WHERE gone) AS n_sources
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_dropped, 0) AS n_dropped, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_sources, 0) AS n_sources
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""


@query("op8_lines", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_id is the smallest id that holds the first of a dropped line, else the document's own."""
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    class_id = F.coalesce(F.array_min("repeats_of"), "doc_id").alias("class_id")
    return found.select("doc_id", "text", "n_lines", "n_dropped", class_id, F.size("repeats_of").cast("bigint").alias("n_sources"))


OP9_SQL = r"""
WITH added AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|><|im_sep|><|im_end|>')
    + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM added GROUP BY conv_id
"""


@query("op9_chat", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asked = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    return chat.formatted_digests(rows.unionByName(asked), tokenizer_path("byte_bpe_50k.json"))


OP10_SQL = r"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
  FROM benchmark WHERE text IS NOT NULL
), s AS (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[p:p + 12], ' ') AS gram FROM s),
d AS (
  SELECT row_number() OVER () AS row, doc_id,
    [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
  FROM documents
), z AS (SELECT DISTINCT size FROM g),
p AS (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, z WHERE len(w) >= size),
h AS (SELECT row, p, p.size, item FROM p JOIN g ON p.size = g.size AND array_to_string(w[p:p + p.size - 1], ' ') = gram),
c AS (SELECT row, count(DISTINCT q) AS n FROM (SELECT row, unnest(range(p, p + size)) AS q FROM h) GROUP BY row),
m AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN m USING (row)
"""


@query("op10_decontamination", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(table(spark, sf_dir, "embeddings"))


@query("op12_quality")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM d),
s AS (SELECT lang, w, unnest(range(1, least(5, len(w)) + 1)) AS size FROM w),
o AS (SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM s),
f AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM o GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
g AS (SELECT * FROM f WHERE f >= 100),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM g WHERE size > 1),
u AS (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c)),
b AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM u GROUP BY ALL),
p AS (SELECT c.* FROM c LEFT JOIN b ON c.lang = b.lang AND c.phrase = b.phrase WHERE longer IS NULL OR longer < a),
k AS (SELECT *, unnest(range(1, size)) AS k FROM p),
x AS (
  SELECT k.lang, k.phrase, k.a, k, l.f AS l, r.f AS r, n,
    CAST((CAST(1000 AS HUGEINT) * k.a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM k JOIN g l ON k.lang = l.lang AND array_to_string(w[1:k], ' ') = l.phrase
  JOIN g r ON k.lang = r.lang AND array_to_string(w[k + 1:k.size], ' ') = r.phrase JOIN t ON k.lang = t.lang
), y AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y WHERE cut = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000
"""


@query("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
