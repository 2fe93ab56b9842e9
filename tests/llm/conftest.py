import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text[, lang, source])."""

    def build(rows, extra: bool = False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        docs = spark.createDataFrame(full, SCHEMA)
        if extra:  # names that an operator might use itself
            for name in ("score", "fingerprint", "row", "k", "slot", "ids", "digest", "hash", "removed", "__text_hash"):
                docs = docs.selectExpr("*", f"'x' AS `{name}`")
        return docs

    return build


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "a text without a number"), (None, None), (5, "same text here"), (5, "same text here"),
    (6, "same text here"), (7, "wide " * 40_000), (8, "x" * 120_000), (9, "1234 5678 !!"), (10, "Ünï \u00e9\u4e2d\u6587 \U0001f389 \x00 end"),
]


@pytest.fixture
def odd(make):
    """Nulls, empty and very long texts, repeated rows and ids, and clashing column names."""
    return make(ODD, extra=True)
