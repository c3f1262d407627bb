"""Findings of the third review."""

from __future__ import annotations

import datetime
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioscan import plans
from folioscan.functions import vectors
from folioscan.operators import entities, retrieval, segment, stats

QUERIES, SQL = plans.load()


def test_floor_is_of_two_questions_in_fifty(spark, tmp_path):
    draw = np.random.default_rng(3).normal(size=(400, 8))
    v = draw / np.linalg.norm(draw, axis=1)[:, None]
    spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    scores = v @ v.T - 9 * np.eye(400)
    best = {k: scores[k].max() for k in range(400) if k % 50 in (3, 4)}
    r = QUERIES["calibrate_floor"](spark, str(tmp_path)).first()
    assert r.noise_top == round(max(b for k, b in best.items() if k % 100 < 50), 6)
    assert r.signal_low == round(min(b for k, b in best.items() if k % 100 >= 50), 6)


def test_questions_of_several_passes_rank_alike(spark, monkeypatch):
    draw = np.random.default_rng(4).normal(size=(300, 4))
    v = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(draw)], "note_id long, v array<double>")
    q = v.select(F.col("note_id").alias("question_id"), F.col("v").alias("q"))
    rank = lambda: sorted((r.question_id, r.note_id, round(r.score, 9), r.rank) for r in retrieval.cosine_ranking(v, q, depth=3).collect())
    once = rank()
    monkeypatch.setattr(retrieval, "MOST_QUESTIONS", 40)
    assert rank() == once and len(once) == 900


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_mentions_are_found_in_one_pass_over_the_diaries(spark):
    """One reading of the orders serves the entries, their documents and the counts of each kind."""
    for name in ("composition", "mention_tally", "said_once", "mention_presence", "grid_rows"):
        assert scans(QUERIES[name](spark, "/root/testdata/sf0.001")) == 1, name


def test_accepted_in_is_mentions_in_of_accepted(spark):
    rows = [(1, 0, "We met Ann Holt in Paris."), (1, 1, "PARIS again, and ann holt."), (1, 2, None), (2, 0, "in paris no name"), (2, 1, "Oslo. Ann Holt?"), (3, 0, "")]
    pieces = spark.createDataFrame(rows, "doc_id long, idx int, text string")
    finders = {"place": entities.places, "person": entities.full_names}
    docs = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("e")).select("doc_id", F.array_join(F.transform("e", lambda x: x["text"]), "\n\n").alias("text"))
    want = sorted(map(tuple, entities.mentions_in(pieces, entities.accepted(docs, finders)).collect()))
    assert sorted(map(tuple, entities.accepted_in(pieces, finders).collect())) == want and len(want) >= 4


def test_a_text_is_embedded_by_its_words_hashed_once(spark):
    """The vector of a text is what its words' slots give, and no lambda of the plan goes through the words for each dimension."""
    said = ["the the boiler", "", None, "Ærø øl 1995 'tis it's", "an"]
    rows = spark.createDataFrame(list(enumerate(said)), "k int, t string")
    slots = rows.select("k", F.transform(F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}']{3,}"), F.lit(0)), lambda w: vectors.hash_slot(w)).alias("s"))
    want = {r.k: np.bincount(r.s or [], minlength=64) for r in slots.collect()}
    df = rows.select("k", vectors.embed(F.col("t")).alias("v"))
    for r in df.collect():
        n = np.sqrt((want[r.k] ** 2).sum())
        assert r.v is None if said[r.k] is None else np.allclose(r.v, want[r.k] / (n or 1), atol=1e-15)
    assert "sequence(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_notes_are_made_once(spark):
    plan = QUERIES["notes_within_window"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_postings_of_a_note_need_no_shuffle(spark):
    notes = spark.createDataFrame([(1, 7, "b a b"), (2, 7, ""), (3, 8, None), (4, 8, "a É")], "note_id long, doc_id long, text string")
    p = retrieval.postings(notes)
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.note_id, r.doc_id, r.token, r.length, r.positions) for r in p.collect())
    assert got == [(1, 7, "a", 3, [1]), (1, 7, "b", 3, [0, 2]), (4, 8, "a", 2, [0]), (4, 8, "e", 2, [1])]


def test_passes_hold_slices_of_bounded_text():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * 900_000] * 3 + [None, "", "y" * 5_000_000])], names=["k", "t"])
    parts = list(segment._slices(batch, 1))
    assert [p.num_rows for p in parts] == [2, 3, 1] and pa.concat_tables([pa.table(p) for p in parts]).equals(pa.table(batch))


def test_names_of_a_document_are_made_once(spark):
    """One reading of the diaries, dealt once: entries, documents and pairs of names stay where the window put them."""
    df = QUERIES["spelled_two_ways"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert scans(df) == 1 and plan.count("Exchange hashpartitioning") == 1


def test_phrases_are_counted_once_and_as_they_stand(spark):
    """Repeated, overlapping and prefix phrases against a plain count; the counts serve document frequencies and scores."""
    said = ["boilers boiler BOIL a b a b a", "well known well-knowing, well", "", None, "a b", "b a well", "Éa b knownwell"]
    notes = spark.createDataFrame([(k, k // 2, t) for k, t in enumerate(said)], "note_id long, doc_id long, text string")
    phrases = [(["boil"], True), (["boiler"], True), (["a"], False), (["a", "b"], False), (["a", "b", "a"], False), (["well", "know"], True), (["ea", "b"], False), (["no"], False)]
    toks = notes.select("note_id", "doc_id", retrieval.tokens(F.col("text")).alias("t"))
    words = {r.note_id: r.t or [] for r in toks.collect()}
    fits = lambda w, want, opens: w.startswith(want) if opens else w == want
    plain = {}
    for k, ws in words.items():
        for p, opens in phrases:
            f = sum(ws[i : i + len(p) - 1] == p[:-1] and fits(ws[i + len(p) - 1], p[-1], opens) for i in range(len(ws) - len(p) + 1))
            if f:
                plain[(k, k // 2, len(ws), tuple(p), opens)] = f
    found = retrieval._phrase_counts(toks, spark.createDataFrame(phrases, "phrase array<string>, is_prefix boolean"))
    assert {(r.note_id, r.doc_id, r.length, tuple(r.phrase), r.is_prefix): r.f for r in found.collect()} == plain and len(plain) == 10
    asked = spark.createDataFrame([(1, "Which boiler is well-known?")], "question_id long, question string")
    ranking = retrieval.bm25(notes, asked)
    assert len(ranking.collect()) == 2 and "ReusedExchange" in ranking._jdf.queryExecution().executedPlan().toString()


def test_terms_are_found_in_one_pass_without_shuffling_texts(spark):
    """One reading of the orders serves what a diary has and lacks; texts are made after its entries are dealt and numbered."""
    for name in ("question_facts", "fact_sentences", "absent_terms", "term_facts"):
        found = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert scans(found) == 1, name
        dealt = found._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(doc_id", 1)[1]
        assert "was placed for" not in dealt, name


def test_found_terms_are_what_their_patterns_find(spark):
    """Terms of any characters, openings of each other, in either case, said again in an entry: as each term's own pattern counts, entry by entry."""
    terms = ["order", "ord", "may", "well-known", "a-a", "café", "it's", "c.d", "199", "Paris", "wör", "none", "x_1"]
    said = [
        "Order 1995, orders ORDERED orderings; may Mayor maybe. reorder", "A well-known, Well-Knowns well-knownest unwell-known", "a-a-a a-a x-a-a a-abcd", "cafécafé Café caféabc cafés", "It's its it'sabcd",
        "c.d cxd C.De", "paris PARISIAN parisians_x", "wörter wör-x", "", None, "x_1 X_1234 x_12345 _x_1", "may may march",
    ]
    rows = [(k % 5 if k != 7 else None, k, datetime.date(2020, 1, k + 1) if k % 3 else None, t) for k, t in enumerate(said)]
    entries = spark.createDataFrame(rows, "doc_id long, idx int, date date, text string")
    want = {}
    for doc, idx, date, text in rows:
        for t in terms if text is not None else ():
            opens = rf"(?<![A-Za-z0-9_]){re.escape(t)}"
            # as Java does without UNICODE_CASE: only A-Z have another case
            if re.search(opens, _ascii(text, t), re.A):
                want.setdefault((doc, t), []).append((idx, date, len(re.findall(opens + r"[A-Za-z0-9_]{0,3}(?![A-Za-z0-9_])", _ascii(text, t), re.A))))
    want = {k: (sum(n for *_, n in v), len(v), min(v, key=lambda x: x[0])[1], max(v, key=lambda x: x[0])[1]) for k, v in want.items()}
    held = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(r.doc_id, r.term): (r.occurrences, r.entry_hits, r.first_date, r.last_date) for r in stats.found_terms(entries, held).collect()}
    assert got == want and len(want) > 12
    every = {(r.doc_id, r.term): (r.occurrences, r.entry_hits, r.first_date, r.last_date) for r in stats.term_counts(entries, held).collect()}
    docs = {r[0] for r in rows}
    assert every == {(d, t): want.get((d, t), (0, 0, None, None)) if d is not None else (0, 0, None, None) for d in docs for t in terms}
    assert stats.found_terms(entries, held.filter("false")).count() == 0 == stats.term_counts(entries, held.filter("false")).count()


def _ascii(text: str, term: str) -> str:
    """text with A-Z as in the term: both in lower case, or the term as it is where it has capitals."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return low if term == term.lower() else re.sub(re.escape(term.lower()), lambda m: term, low)
