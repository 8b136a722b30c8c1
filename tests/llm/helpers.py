"""Small document tables with everything that can go wrong in them."""

import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside or return.
CLASH = ["kept", "size", "digest", "row_no", "n", "h", "group", "node", "ids", "spans", "bitmap", "score", "target", "at", "words", "n_words", "cut", "doc_key"]


def docs(spark, rows, clash=False):
    """``rows``: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.selectExpr("*", *[f"'x' AS {c}" for c in CLASH]) if clash else df


ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "a"), (5, "a"), (5, "a"), (None, "a"), (None, None), (6, "x" * 70_000), (7, "ä日本 🙂 b c"),
    (8, "\n\n\n"), (9, "word " * 5_000),
]


def words(text):
    return WORD.findall(text or "")
