"""Places, people and amounts named in text, and what is counted of them.

Finders are column functions: text -> array of values as written, repeats kept.
A mention is accepted for a whole document (distinct by lower case, the first
spelling stays) and then looked for in each entry or note.

Word lists (places, words that are no names, openers) are parameters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import words_array
from ..lexicons import NOT_NAME_WORDS, OPENERS, PLACES
from ..regex import B0, B1
from ..session import ship

_CAP = r"[A-Z][\p{L}'’.-]+"
_NAME = r"[A-Z][\p{L}'’-]*\p{L}"
BEFORE_PLACE = r"(?:in|at|to|from|near|around|outside|across|via|visit(?:ed|ing)?|mov(?:ed|ing) to|flew to|drove to|based in|living in)"
AMOUNT = rf"(?i)(?:(?:{B0}(?:CA|US|AU|NZ)\$|\$|€|£)\s?[0-9][0-9,]*(?:\.[0-9]{{1,2}})?{B1}|{B0}[0-9][0-9,]*(?:\.[0-9]{{1,2}})?\s?(?:dollars|euros|pounds|cents){B1})"
HONORIFIC = rf"{B0}(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Rev|Capt|Sgt|Fr)\.?\s+([A-Z][\p{{L}}'’-]+)"


def _literal(words: Sequence[str]) -> Column:
    return words_array(sorted({w.lower() for w in words}))


def _any_word(phrase: Column, words: Sequence[str]) -> Column:
    parts = F.transform(F.split(phrase, r"[\s.]+"), lambda w: F.lower(w))
    return F.arrays_overlap(parts, _literal(words))


def amounts(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)), lambda x: F.trim(x))


def honorific_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HONORIFIC), F.lit(1))


def places(text: Column, gazetteer: Sequence[str] = PLACES, openers: Sequence[str] = OPENERS, no_names: Sequence[str] = NOT_NAME_WORDS) -> Column:
    """After a preposition: several capitalised words, or one that the gazetteer has; anywhere: gazetteer words."""
    known = _literal(gazetteer)
    phrases = F.regexp_extract_all(text, F.lit(rf"{B0}{BEFORE_PLACE}\s+({_CAP}(?:\s+{_CAP}){{0,2}})"), F.lit(1))

    def right(p: Column) -> Column:
        w = F.split(p, r"\s+")
        return (F.length(p) >= 3) & ~F.array_contains(_literal(openers), F.lower(F.get(w, F.lit(0)))) & ~_any_word(p, no_names) & ((F.size(w) > 1) | F.array_contains(known, F.lower(p)))

    words = F.regexp_extract_all(text, F.lit(r"[A-Z][\p{L}'’.-]*"), F.lit(0))
    return F.concat(F.filter(phrases, right), F.filter(words, lambda w: (F.length(w) > 2) & F.array_contains(known, F.lower(w))))


def full_names(text: Column, gazetteer: Sequence[str] = PLACES, openers: Sequence[str] = OPENERS, no_names: Sequence[str] = NOT_NAME_WORDS) -> Column:
    """Two or three capitalised words in a row that don't open with a place, an opener or capitals alone."""
    found = F.regexp_extract_all(text, F.lit(rf"{B0}{_NAME}\s+{_NAME}(?:\s+{_NAME})?"), F.lit(0))
    found = F.transform(found, lambda p: F.regexp_replace(p, r"\s+", " "))

    def right(p: Column) -> Column:
        first = F.get(F.split(p, " "), F.lit(0))
        shout = (F.length(first) > 1) & (first == F.upper(first))
        return ~F.array_contains(_literal([*openers, *gazetteer]), F.lower(first)) & ~shout & ~F.array_contains(_literal(gazetteer), F.lower(p)) & ~_any_word(p, no_names)

    return F.filter(found, right)


_LONE = re.compile(r"(?<![A-Za-z0-9_])[A-Z][a-z]{2,15}(?![A-Za-z0-9_])")
_ENDS = set(".!?-–—*•·>|(\"'")


def lone_names_of(text: str, near_places: Sequence[str], refused: frozenset[str]) -> list[str]:
    """First names alone: seen twice or more, once at least within a sentence."""
    total, within = Counter(), Counter()
    joined = "\n".join(p.lower() for p in near_places)
    for m in _LONE.finditer(text):
        word, at = m[0], m.start()
        before = text[at - 1] if at else "\n"
        if before not in " \n" or not re.match(r"\s+[a-z’']", text[m.end() : m.end() + 40]) or word.lower() in refused or word.lower() in joined:
            continue
        total[word] += 1
        last = text[max(0, at - 200) : at].rstrip()[-1:]
        within[word] += before == " " and bool(last) and last not in _ENDS
    return [w for w in total if total[w] > 1 and within[w] for _ in range(total[w])]


def lone_names(text: Column, found_places: Column, gazetteer: Sequence[str] = PLACES, openers: Sequence[str] = OPENERS, no_names: Sequence[str] = NOT_NAME_WORDS) -> Column:
    """Needs the text around each name, which SQL's patterns don't give: Arrow-batched, over whole documents."""
    refused = frozenset(w.lower() for w in [*gazetteer, *openers, *no_names])

    def run(texts: pd.Series, near: pd.Series) -> pd.Series:
        return pd.Series([lone_names_of(t or "", [] if p is None else list(p), refused) for t, p in zip(texts, near, strict=True)])

    return F.pandas_udf(run, "array<string>")(text, found_places)


def accepted(docs: DataFrame, finders: dict[str, object]) -> DataFrame:
    """doc_id, kind, value, first_at: distinct values of each document by lower case, as first written."""
    found = F.flatten(F.array(*[F.transform(f(F.col("text")), lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), i.alias("at"))) for kind, f in _bound(finders)]))
    rows = docs.select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.*")
    return rows.groupBy("doc_id", "kind", F.lower("value").alias("key")).agg(F.min_by("value", "at").alias("value"), F.min("at").alias("first_at")).drop("key")


def _bound(finders: dict[str, object]) -> list:
    return sorted(finders.items())


_LOWER = {c: c + 32 for c in range(65, 91)}


def matcher(values: Sequence[str]):
    """A function text -> places in values of those that it holds as whole words, ASCII letters in any case.

    One Aho-Corasick automaton over all values: a text is gone through once, however many they are.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    spelled: dict[str, list[int]] = {}
    for k, v in enumerate(values):
        if v:
            spelled.setdefault(v.translate(_LOWER), []).append(k)
    for low, places in spelled.items():
        automaton.add_word(low, (len(low), places))
    if not spelled:
        return lambda text: set()
    automaton.make_automaton()
    inside = lambda c: c.isascii() and (c.isalnum() or c == "_")

    def held(text: str) -> set[int]:
        low, out = text.translate(_LOWER), set()
        for end, (n, places) in automaton.iter(low):
            start = end - n + 1
            if (start == 0 or not inside(low[start - 1])) and (end + 1 == len(low) or not inside(low[end + 1])):
                out.update(places)
        return out

    return held


def mentions_in(pieces: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, piece id `idx`, kind, value: accepted values that a piece holds as whole words, in any case.

    A document's pieces and its values meet by document; there each text goes once through an
    automaton of all values. Values without their document's pieces are never met.
    """
    ship(pieces.sparkSession)
    kinds = {"doc_id": pieces.schema["doc_id"].dataType.simpleString(), "idx": pieces.schema["idx"].dataType.simpleString()}
    texts = pieces.filter(F.col("text").isNotNull()).groupBy("doc_id").agg(F.collect_list(F.struct("idx", "text")).alias("pieces"))
    mine = values.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("kind", "value"))).alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, wanted = batch.column(1).slice(k, 1).flatten(), batch.column(2).slice(k, 1).flatten()
                held = matcher(wanted.field(1).to_pylist())
                found = [(i, v) for i, text in enumerate(own.field(1).to_pylist()) for v in sorted(held(text))]
                if found:
                    at, which = (pa.array(x, pa.int64()) for x in zip(*found, strict=True))
                    ids = batch.column(0).take(pa.array([k] * len(found)))
                    yield pa.RecordBatch.from_arrays([ids, own.field(0).take(at), wanted.field(0).take(which), wanted.field(1).take(which)], names=["doc_id", "idx", "kind", "value"])

    return texts.join(mine, "doc_id").mapInArrow(run, f"doc_id {kinds['doc_id']}, idx {kinds['idx']}, kind string, value string")


def found(pieces: DataFrame, finders: dict[str, object]) -> DataFrame:
    """(doc_id, idx, text) -> doc_id, idx, kind, value, pos of every mention, in one pass over the pieces."""
    # an array as written: of any other the planner would first test the size, and so find all twice
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), f(F.col("text")).alias("values")) for kind, f in _bound(finders)])
    rows = pieces.select("doc_id", "idx", F.explode(each).alias("k"))
    return rows.select("doc_id", "idx", "k.kind", F.posexplode("k.values").alias("pos", "value"))


def accepted_in(pieces: DataFrame, finders: dict[str, object]) -> DataFrame:
    """mentions_in() of pieces (doc_id, idx, text) and the values accepted() of their documents, joined by blank lines: pieces are grouped once."""
    ship(pieces.sparkSession)
    kinds = {c: pieces.schema[c].dataType.simpleString() for c in ("doc_id", "idx")}
    docs = pieces.filter("text IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("pieces"))
    docs = docs.withColumn("text", F.array_join(F.transform("pieces", lambda x: x["text"]), "\n\n"))
    named = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lower(v).alias("key"))
    values = F.flatten(F.array(*[F.transform(f(F.col("text")), named(kind)) for kind, f in _bound(finders)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, docs_of, kind_of, value_of = [], [], [], []
            places = batch.column(1).offsets.to_pylist()
            texts = batch.column(1).values.field(1)
            for k in range(batch.num_rows):
                first: dict[tuple, str] = {}
                for v in batch.column(2)[k].as_py():
                    first.setdefault((v["kind"], v["key"]), v["value"])
                wanted = sorted((kind, value) for (kind, _), value in first.items())
                held = matcher([v for _, v in wanted])
                for j in range(places[k], places[k + 1]):
                    for w in sorted(held(texts[j].as_py())):
                        docs_of.append(k)
                        at.append(j)
                        kind_of.append(wanted[w][0])
                        value_of.append(wanted[w][1])
            if at:
                idx = batch.column(1).values.field(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs_of, pa.int64())), idx, pa.array(kind_of, pa.string()), pa.array(value_of, pa.string())], names=["doc_id", "idx", "kind", "value"])

    return docs.select("doc_id", "pieces", values.alias("values")).mapInArrow(run, f"doc_id {kinds['doc_id']}, idx {kinds['idx']}, kind string, value string")


def tally(rows: DataFrame) -> DataFrame:
    """(doc_id, kind, value, idx, pos) -> doc_id, kind, value as first written, count, entries (distinct, sorted)."""
    clean = rows.withColumn("value", F.trim("value")).filter("value <> ''")
    counted = clean.groupBy("doc_id", "kind", F.lower("value").alias("key")).agg(F.min_by("value", F.struct("idx", "pos")).alias("value"), F.count("*").alias("count"), F.array_sort(F.collect_set("idx")).alias("entries"))
    return counted.drop("key")


def top_mentions(tallied: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The most counted of each kind and document, names in collation order among equals, with their rank."""
    w = Window.partitionBy("doc_id", "kind").orderBy(F.desc("count"), F.collate(F.lower("value"), "UNICODE"), "value")
    cap = F.create_map(*[F.lit(x) for k, n in caps.items() for x in (k, n)])
    most = max(caps.values())
    ranked = tallied.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return ranked.filter(F.col("rank") <= cap[F.col("kind")])


def pin_images(images: DataFrame, entries: DataFrame) -> DataFrame:
    """images (doc_id, pos, url, caption) with entry_idx: the first entry that holds the caption's first 40 characters, else -1."""
    needle = F.substring("caption", 1, 40)
    e = entries.select("doc_id", F.col("idx"), F.col("text"))
    hit = images.filter("caption <> ''").join(e, "doc_id").filter(F.contains(F.col("text"), needle)).groupBy("doc_id", "pos").agg(F.min("idx").alias("entry_idx"))
    return images.join(hit, ["doc_id", "pos"], "left").withColumn("entry_idx", F.coalesce("entry_idx", F.lit(-1)))
