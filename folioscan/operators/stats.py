"""Counts over whole documents: entries, months, terms."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import words_array
from ..functions.text import count_words
from ..regex import B0, B1


def document_stats(entries: DataFrame) -> DataFrame:
    """A row a document. first_date and last_date are those of the first and last dated entry in reading order."""
    has = F.col("date").isNotNull()
    at = F.when(has, F.col("idx"))
    return entries.groupBy("doc_id").agg(
        F.count("*").alias("entries"), F.count("date").alias("dated_entries"), F.count("month").alias("placed_entries"),
        (F.count("month") - F.count("date")).alias("month_precision"), F.count_distinct("month").alias("months"),
        F.sum(F.length("text")).alias("characters"), F.sum(count_words(F.col("text"))).alias("words"),
        F.min_by("date", at).alias("first_date"), F.max_by("date", at).alias("last_date"), F.min("date").alias("min_date"), F.max("date").alias("max_date"),
    )


def entries_per_month(entries: DataFrame) -> DataFrame:
    return entries.filter("month IS NOT NULL").groupBy("doc_id", "month").agg(F.count("*").alias("entries"))


def escaped(term: Column) -> Column:
    return F.regexp_replace(term, r"([\\.*+?^${}()|\[\]])", r"\\$1")


def term_counts(entries: DataFrame, terms: DataFrame) -> DataFrame:
    """found_terms() with a count of 0 for each document that a term isn't found in: a row a document and term."""
    held = held_terms(terms)
    return terms_of_documents(entries, held, held)


def found_terms(entries: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, term, occurrences, entry_hits, first_date, last_date of the terms that a document has.

    terms is a small table (a question's words), of at most MOST_TERMS rows.
    Occurrences are the word with up to three more letters; entries are hit by its opening alone.
    """
    return _counted(_met(entries, held_terms(terms), F.col("text")).filter("term IS NOT NULL"))


def terms_of_documents(entries: DataFrame, terms: list[str], always: list[str]) -> DataFrame:
    """found_terms() of every document; of the terms in always, also a row of zeros where a document has none. Entries are gone through once."""
    # entries of no document are of no use, but are a document that lacks every term
    per = _counted(_met(entries, terms, F.when(F.col("doc_id").isNotNull(), F.col("text"))))
    columns = ["term", "occurrences", "entry_hits", "first_date", "last_date"]
    docs = per.groupBy("doc_id").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct(*columns))).alias("found"))
    kinds = {c: per.schema[c].dataType.simpleString() for c in columns}
    none = lambda t: F.struct(t.alias("term"), *[F.lit(0 if c in ("occurrences", "entry_hits") else None).cast(kinds[c]).alias(c) for c in columns[1:]])
    missing = F.transform(F.array_except(words_array(always), F.transform("found", lambda f: f["term"])), none)
    return docs.select("doc_id", F.inline(F.concat("found", missing)))


def held_terms(terms: DataFrame) -> list[str]:
    """The distinct terms of a small table, in order."""
    return sorted({r.term for r in _few(terms.select("term")) if r.term is not None})


def any_of(words: Iterable[str]) -> str:
    """A pattern of what opens with one of the words: a tree by their letters, so that a place is tried letter by letter and not word by word."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    if "" in by:  # the shortest says it all
        return ""
    parts = [re.sub(r"[\\.*+?^${}()|\[\]]", r"\\\g<0>", first) + any_of(rest) for first, rest in sorted(by.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


_PLAIN = re.compile(r"[A-Za-z0-9_]+")


def _met(entries: DataFrame, terms: list[str], text: Column) -> DataFrame:
    """doc_id, idx, date, term, n, first (of this term in its entry): a row for each word of a text that opens with a term; without a term, a row for each entry that has none.

    Terms of ASCII word characters meet the words of a text: one pattern, the same for all rows, finds the words that open with any of them. Other terms are
    sought by patterns of their own, in texts that one pattern of all of them fits.
    """
    plain, other = [t for t in terms if _PLAIN.fullmatch(t)], [t for t in terms if not _PLAIN.fullmatch(t)]
    word = lambda w, n: F.struct(w.alias("w"), n.alias("n"))
    none = F.array().cast("array<struct<w:string,n:int>>")
    arrays = [none]
    if plain:
        words = F.regexp_extract_all(text, F.lit(rf"(?i){B0}{any_of({t.lower() for t in plain})}[A-Za-z0-9_]*"), F.lit(0))
        arrays.append(F.transform(words, lambda w: word(F.lower(w), F.lit(None).cast("int"))))
    if other:
        begins = lambda t, more="": F.concat(F.lit(f"(?i){B0}"), escaped(t), F.lit(more))
        held = F.array(*[F.lit(t) for t in other])
        theirs = F.filter(held, lambda t: F.regexp_like(text, begins(t)))
        there = F.transform(theirs, lambda t: word(t, F.regexp_count(text, begins(t, f"[A-Za-z0-9_]{{0,3}}{B1}"))))
        arrays.append(F.when(text.rlike(f"(?i){B0}{any_of(other)}"), there).otherwise(none))
    rows = entries.select("doc_id", "idx", "date", F.concat(*arrays[1:] or arrays).alias("words")).select("doc_id", "idx", "date", "words", F.posexplode_outer("words").alias("at", "word"))
    n_open = min(map(len, terms), default=0)
    table = entries.sparkSession.createDataFrame([(t, t.lower(), t in set(plain), t.lower()[:n_open]) for t in terms], "term string, low string, plain boolean, opening string")
    w, n, low = F.col("word.w"), F.col("word.n"), F.col("low")
    # a term that isn't plain comes as itself, with its count
    same = (F.substring(F.lower(w), 1, n_open) == F.col("opening")) & F.when(n.isNull(), F.col("plain") & F.startswith(w, low)).otherwise(w == F.col("term"))
    met = rows.join(F.broadcast(table), same, "left")
    again = F.exists(F.slice("words", 1, F.col("at")), lambda o: o["n"].isNull() & F.startswith(o["w"], low))
    return met.select(
        "doc_id", "idx", "date", "term", F.coalesce(n, (F.length(w) - F.length(low) <= 3).cast("int")).alias("n"), (n.isNotNull() | (F.col("at") == 0) | ~again).alias("first"),
    )


def _counted(met: DataFrame) -> DataFrame:
    return met.groupBy("doc_id", "term").agg(F.sum("n").alias("occurrences"), F.count_if("first").alias("entry_hits"), F.min_by("date", "idx").alias("first_date"), F.max_by("date", "idx").alias("last_date"))


MOST_TERMS = 1000


def small(terms: DataFrame) -> DataFrame:
    """terms for a broadcast; more rows than MOST_TERMS are an error, not a slow plan."""
    if terms.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} terms at once")
    return F.broadcast(terms)


def _few(terms: DataFrame) -> list:
    """The rows of a table that small() takes."""
    rows = terms.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} terms at once")
    return rows


def month_comparison(entries: DataFrame, months: list[int]) -> DataFrame:
    """doc_id, month number, entries, words and distinct long words of dated entries in these calendar months."""
    rows = entries.filter(F.col("date").isNotNull()).withColumn("number", F.month("date")).filter(F.col("number").isin(months))
    long_words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}']{4,}"), F.lit(0))
    counts = rows.groupBy("doc_id", "number").agg(F.count("*").alias("entries"), F.sum(count_words(F.col("text"))).alias("words"))
    distinct = rows.select("doc_id", "number", F.explode(long_words).alias("w")).distinct().groupBy("doc_id", "number").agg(F.count("*").alias("distinct_words"))
    return counts.join(distinct, ["doc_id", "number"], "left").na.fill(0, ["distinct_words"])
