"""Awkward tables: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

CLASHING = "key string, body string, word string, line string, node string, component string, doc string, fp string, row string, places string"


def odd_documents(spark, texts, start=0):
    """Documents with the given texts, null ids and texts, a repeated row and clashing columns."""
    rows = [(start + i, t) for i, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, "  \n\t "), (903, "long word " * 20_000), (903, "long word " * 20_000), (None, "a text without an id, long enough"), (904, "ends with blank ")]
    names = [c.split()[0] for c in CLASHING.split(", ")]
    return rows, spark.createDataFrame([(*r, *(["x"] * len(names))) for r in rows], f"doc_id bigint, text string, {CLASHING}")


def by_id(rows, name="doc_id"):
    out = {}
    for r in rows:
        out.setdefault(r[name], []).append(r)
    return out
