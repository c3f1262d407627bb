"""Small helpers of column functions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """body(value), with value computed once even where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def words_array(words: Iterable[str]) -> Column:
    """A constant array of strings without line feeds. It is folded when it is planned; an array of literals would take a call to the JVM for each."""
    held = list(words)
    return F.split(F.lit("\n".join(held)), "\n") if held else F.array().cast("array<string>")


def batched(returns: str):
    """Like pandas_udf, but made on first use: a DDL type can't be parsed before there is a session."""

    def decorate(f):
        made = cache(lambda: F.pandas_udf(f, returns))

        @wraps(f)
        def call(*columns):
            return made()(*columns)

        return call

    return decorate
