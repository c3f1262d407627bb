"""Patterns that mean the same in Spark (Java), DuckDB (RE2) and Python.

Java's word boundary takes accented letters for word characters, RE2's doesn't;
patterns here are written with ASCII look-arounds for Spark, and `sql()` turns
those into the plain boundary that RE2 has.
"""

from __future__ import annotations

#: Boundary before or after an ASCII word character.
B0 = r"(?<![A-Za-z0-9_])"
B1 = r"(?![A-Za-z0-9_])"
WORD = r"[\p{L}\p{N}'’-]+"


def word(body: str) -> str:
    """body as a whole word, by ASCII boundaries."""
    return f"{B0}(?:{body}){B1}"


def sql(pattern: str) -> str:
    """The same pattern for RE2."""
    return pattern.replace(B0, r"\b").replace(B1, r"\b")


def quoted(value: str) -> str:
    """A DuckDB string literal."""
    return "'" + value.replace("'", "''") + "'"
