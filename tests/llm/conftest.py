from __future__ import annotations

import pytest

#: Columns that operators use inside; none may clash.
EXTRA = ["batch", "row", "node", "component", "token", "rep", "a", "b", "tag", "bucket", "n", "size", "digest", "hash", "_id"]


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from (doc_id, text, lang, source) with clashing extra columns."""

    def make(rows):
        rows = [(*r, *["en", "s"][len(r) - 2 :]) if len(r) < 4 else r for r in rows]
        data = [(i, t, lang, src, None if t is None else len(t), *["x"] * len(EXTRA)) for i, t, lang, src in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
        return spark.createDataFrame(data, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = "wörd number %d " * 3000 % tuple(range(3000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one  two "), (6, long), (7, long + "x"), (8, "ONE two"), (8, "ONE two"),
        (None, "one two"), (None, None), (9, "q" * 70000), (10, "a b c d e f g h i j"), (11, "a b c d e f g h i j"), (-3, "A b c d e f g h i j"), (12, "é 😀  x"),
        (13, None, None, None), (14, "word " * 40, "de", None),
    ]
