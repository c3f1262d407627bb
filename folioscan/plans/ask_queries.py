"""Queries that ask a stored index: postings by slot, rankings, what is shown and how much of how much."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_words
from ..operators import entities as en
from ..operators import retrieval as rt
from ..session import shared_folder
from . import corpora
from .corpora import DIARY_SQL
from .engine import Engine
from .registry import query
from .search_queries import _DIARY_NOTES, _FUSED, _SLOT, ASKED_SQL, asked, bm25_sql


def new_engine(read) -> Engine:
    spark = read("region").sparkSession
    return Engine(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def document_index(read) -> Engine:
    """A store whose notes are whole documents."""
    engine = new_engine(read)
    notes = read("documents").select(F.col("doc_id").alias("note_id"), "doc_id", "text", F.size(rt.tokens(F.col("text"))).alias("tokens"))
    engine.store.insert({"notes": notes.withColumn("text", F.coalesce("text", F.lit(""))), "sizes": lambda written: rt.note_sizes(written("notes")), "postings": lambda written: rt.postings(written("notes"))})
    return engine


def diary_index(read) -> Engine:
    """A store whose entries and notes are those of the diaries."""
    engine = new_engine(read)
    d = corpora.diary(read)
    text, day = F.col("text"), F.date_format("date", "yyyy-MM-dd")
    no = lambda kind: F.lit(None).cast(kind)
    entries = d.select("doc_id", F.col("idx").cast("int").alias("idx"), "heading", "text", day.alias("date"), "date_raw", F.lit(False).alias("ambiguous"), "month")
    label = F.coalesce("date_raw", "heading", F.concat(F.lit("Entry "), (F.col("idx") + 1).cast("string")))

    def notes(written) -> DataFrame:
        e = written("entries")
        return e.select(
            (F.col("doc_id") * 1000 + F.col("idx")).alias("note_id"), "doc_id", F.col("idx").alias("entry_idx"), F.lit(0).alias("part"), "heading", "date", "date_raw", label.alias("label"), "text",
            count_words(text).alias("words"), F.size(rt.tokens(text)).alias("tokens"), en.places(text).alias("places"), en.full_names(text).alias("people"), en.amounts(text).alias("amounts"), no("array<string>").alias("images"),
        )

    documents = d.select("doc_id").distinct().select("doc_id", F.concat(F.lit("Diary "), F.col("doc_id").cast("string")).alias("title"), no("string").alias("source_name"))
    engine.store.insert({
        "documents": documents, "entries": entries, "notes": notes, "vectors": lambda written: written("notes").select("note_id", "doc_id", engine.embed(text).alias("v")),
        "sizes": lambda written: rt.note_sizes(written("notes")), "postings": lambda written: rt.postings(written("notes")),
    })
    return engine


@query("bm25_stored", f"WITH {ASKED_SQL}, {bm25_sql('SELECT doc_id AS note_id, doc_id, text FROM documents')} SELECT question_id, note_id, round(score, 6) AS score, rank FROM lexical")
def bm25_stored(read):
    """The ranking of bm25_topk from a stored index: of its postings, those of the questions' terms are read."""
    store = document_index(read).store
    top = rt.bm25_indexed(store.table("postings"), store.table("sizes"), asked(read), expand=False)
    return top.select("question_id", "note_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_EMBEDDED = rf"""nw AS (SELECT note_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}'']{{3,}}')) AS w FROM notes), qw AS (SELECT question_id, unnest(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}'']{{3,}}')) AS w FROM questions),
ns AS (SELECT note_id, {_SLOT} AS slot, count(*) AS n FROM nw GROUP BY 1, 2), qs AS (SELECT question_id, {_SLOT} AS slot, count(*) AS n FROM qw GROUP BY 1, 2),
nn AS (SELECT note_id, sqrt(sum(n * n)) AS norm FROM ns GROUP BY 1), qn AS (SELECT question_id, sqrt(sum(n * n)) AS norm FROM qs GROUP BY 1),
dots AS (SELECT question_id, note_id, sum(ns.n / nn.norm * (qs.n / qn.norm)) AS score FROM ns JOIN qs USING (slot) JOIN nn USING (note_id) JOIN qn USING (question_id) GROUP BY 1, 2),
by_vector AS (SELECT * FROM (SELECT question_id, note_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(coalesce(score, 0), 9) DESC, note_id) AS rank FROM (SELECT question_id, note_id FROM questions, notes) LEFT JOIN dots USING (question_id, note_id)) WHERE rank <= 60)"""
_ASK = rf"""{ASKED_SQL}, {DIARY_SQL}, {bm25_sql(_DIARY_NOTES, expand=True)}, by_words AS (SELECT question_id, note_id, score, rank FROM lexical), {_EMBEDDED}, {_FUSED},
silence AS (SELECT q.question_id, (SELECT count(*) FROM by_words w WHERE w.question_id = q.question_id) = 0 AND coalesce((SELECT max(score) FROM by_vector v WHERE v.question_id = q.question_id), 0) < {rt.FLOOR} AS silent FROM questions q),
dates(question_id, day) AS (VALUES (2::BIGINT, '1995-03-06')),
shown AS (SELECT r.question_id, r.note_id, n.doc_id, row_number() OVER (PARTITION BY r.question_id ORDER BY d.day IS NULL, r.rank) AS rank FROM ranked r JOIN silence USING (question_id) JOIN diary n ON n.doc_id * 1000 + n.idx = r.note_id
 LEFT JOIN dates d ON d.question_id = r.question_id AND d.day = strftime(n.date, '%Y-%m-%d') WHERE NOT silent AND r.rank <= {rt.SHOWN})"""


def asked_diaries(read) -> dict[str, DataFrame]:
    return diary_index(read).ask(asked(read))


@query("ask_shown", f"WITH {_ASK} SELECT question_id, note_id, doc_id, rank FROM shown")
def ask_shown(read):
    """The notes that each question is answered from, over all diaries."""
    return asked_diaries(read)["shown"].select("question_id", "note_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("ask_coverage", f"WITH {_ASK} SELECT s.question_id, s.silent, (SELECT count(*) FROM notes) AS total, (SELECT count(*) FROM shown x WHERE x.question_id = s.question_id) AS shown FROM silence s")
def ask_coverage(read):
    """How many notes each question is answered from, of how many, and whether the search was silent."""
    return asked_diaries(read)["coverage"].select("question_id", "silent", F.col("total").cast("long").alias("total"), F.col("shown").cast("long").alias("shown"))
