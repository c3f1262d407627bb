from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMOKE = "/root/testdata/sf0.001"

ODD_TEXTS = [
    None, "", " \n\t ", "a", "é", "one two", "Edge of the 😀 text here and there. " * 3, "x" * 70_000, "word " * 20_000,
    "Mail a@b.example.com or +1 (555) 010-9999 now.", "same text of some words, repeated in two rows", "same text of some words, repeated in two rows",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty and long texts, repeated rows, null ids, languages and sources, and columns with clashing names."""
    rows = [(k, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else f"s{k % 2}", None if t is None else len(t)) for k, t in enumerate(ODD_TEXTS)]
    rows += [rows[-1], (None, "no id here at all", "de", None, 17), (None, None, None, None, None)]
    extra = [(*r, "x", 1, 2) for r in rows]
    return spark.createDataFrame(extra, SCHEMA + ", fingerprint string, size int, row int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMOKE}/documents.parquet")
