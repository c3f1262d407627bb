"""Asking one document: routing, facts, coverage, warnings; and what is around it."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from folioscan import __main__ as cli
from folioscan.config import Config, env_int
from folioscan.functions import text as tx
from folioscan.operators import retrieval
from folioscan.plans.engine import Busy, Engine
from folioscan.sources import readers

FIRMS = [f"{name} Works" for name in "Amber Birch Cedar Delta Ember Fjord Grove Heath Inlet Jasper Knoll Larch Maple North Olive Pearl Quartz River Slate Thorn".split()]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("asked")))
    body = "\n\n".join(f"{k % 28 + 1} {'May June'.split()[k % 2]} 20{k + 1:02d}\n\nThat year the work was for {f}, and the river stood high." for k, f in enumerate(FIRMS))
    rows = [("firms", body, "Firms", None, None), ("other", "Nothing of note is written here, but it is written at some length, so that it is kept. " * 4, "Other", None, None)]
    assert e.add(spark.createDataFrame(rows, "doc_id string, text string, title string, year_hint int, source_name string"))["added"] == 2
    return e


def put(engine, *rows):
    return engine.ask(engine.spark.createDataFrame([(k, q, d) for k, (q, d) in enumerate(rows)], "question_id long, question string, doc_id string"))


def test_a_list_question_sees_every_note_and_others_the_best(engine):
    out = put(engine, ("List every firm, please.", "firms"), ("What about Cedar Works?", "firms"), ("Which zebras voted?", "other"), ("What date range does it cover?", "firms"), ("What date range does it cover?", "other"))
    texts = {}
    for r in out["shown"].orderBy("question_id", "rank").collect():
        texts.setdefault(r.question_id, []).append(r.text)
        assert r.doc_id == ("other" if r.question_id in (2, 4) else "firms")
    assert all(f in " ".join(texts[0]) for f in FIRMS) and [f for t in texts[0] for f in FIRMS if f in t] == FIRMS  # in order
    assert len(texts[1]) == retrieval.SHOWN and "Cedar" in texts[1][0]
    warnings = {r.question_id: r.warnings for r in out["warnings"].collect()}
    assert "all 20 notes" in warnings[0][0] and 1 not in warnings and "No note matched" in warnings[2][0]
    refused = {r.question_id: r.refused_by for r in out["refused"].collect()}
    assert refused[0] is None and refused[1] is None and refused[2] == "search" and refused[3] is None
    assert "2001" in {r.question_id: r.says for r in out["replies"].collect()}[3]
    assert {(r.question_id, r.kind) for r in out["sentences"].collect()} >= {(0, "date-range"), (1, "count")}
    assert {r.doc_id for r in out["sentences"].filter("question_id = 4").collect()} <= {"other"}
    funnel = {(r.question_id, r.step): r.notes for r in out["funnel"].collect()}
    assert funnel[(0, 0)] == 20 and funnel[(0, 4)] == 20 and funnel[(1, 4)] == 8 and funnel[(2, 1)] == 0
    tallies = {(r.kind, r.value) for r in out["tallies"].filter("question_id = 0").collect()}
    assert len(out["details"].filter("question_id = 0").first().dates) == 20 and isinstance(tallies, set)


def test_the_prompt_tells_facts_and_true_coverage(spark, engine):
    chat = Engine(spark, engine.path, chat=lambda prompt: prompt)
    out = put(chat, ("What about Cedar Works?", "firms"), ("List every firm, please.", "firms"))
    said = {r.question_id: r.reply for r in chat.replies(spark.createDataFrame([(0, "What about Cedar Works?", "firms"), (1, "List every firm, please.", "firms")], "question_id long, question string, doc_id string"), out["shown"], out["sentences"], out["coverage"]).collect()}
    assert "You see 8 of 20 notes." in said[0] and '"cedar": counted 1 times' in said[0] and "20 entries have a date" in said[0]
    assert "You see every note of the document." in said[1]


def test_notes_of_a_date_that_is_asked_come_first(engine):
    out = put(engine, ("Was the river high on 4 June 2004 or another day?", "firms"))
    assert "Delta Works" in out["shown"].orderBy("rank").first().text


def test_a_reranker_without_scores_leaves_the_order(spark, engine):
    none = Engine(spark, engine.path, scorer=lambda q, t: F.lit(None).cast("double"))
    plain, out = put(engine, ("What about Cedar Works?", "firms")), put(none, ("What about Cedar Works?", "firms"))
    order = lambda panels: [r.note_id for r in panels["shown"].orderBy("rank").collect()]
    assert order(out) == order(plain) and "gave no scores" in out["warnings"].first().warnings[0]
    longest = Engine(spark, engine.path, scorer=lambda q, t: F.length(t).cast("double"))
    lengths = [len(r.text) for r in put(longest, ("What about Cedar Works?", "firms"))["shown"].orderBy("rank").collect()]
    assert lengths == sorted(lengths, reverse=True)


def test_stored_postings_rank_as_the_texts_do(spark, engine):
    notes = engine.store.table("notes")
    asked = spark.createDataFrame([(1, "What about the well-known river and Cedar Works in May?"), (2, "the year the work was for Ember"), (3, "zebra"), (4, "river stood high's")], "question_id long, question string")
    for per_document in (False, True):
        want = retrieval.bm25(notes.select("note_id", "doc_id", "text"), asked, per_document=per_document, depth=None)
        got = retrieval.bm25_indexed(engine.store.table("postings"), engine.store.table("sizes"), asked, per_document=per_document, depth=None)
        rows = lambda df: {(r.question_id, r.note_id): round(r.score, 9) for r in df.collect()}
        assert rows(got) == rows(want) and rows(want)


def test_gates_and_stage_times(engine):
    with engine.asking, engine.asking, engine.asking:
        with pytest.raises(Busy):
            put(engine, ("Anything?", "firms"))
    stages = engine.describe()["stages"].collect()
    assert {r.stage for r in stages} == {"documents", "entries", "notes", "vectors", "sizes", "postings"} and abs(sum(r.share for r in stages) - 1) < 1e-9
    panels = engine.describe()
    assert panels["spine"].filter("doc_id = 'firms'").count() > 0 and panels["grid"].columns


def test_settings():
    assert [env_int("X", 5, {"X": v}) for v in ("7", " 12abc", "0", "-3", "", "x")] == [7, 12, 5, 5, 5, 5] and env_int("Y", 5, {}) == 5
    assert Config.read({"FOLIOSCAN_ASKING": "9"}) == Config(asking=9)


def test_events(spark, tmp_path):
    path = str(tmp_path / "e.ndjson")
    lines = ['{"type": "stage", "n": 1}', "", '{"type": "result", "ok": true}', "<!DOCTYPE html><p>", "{broken", '{"type": "error"}', '{"type": "error", "error": "too long"}']
    (tmp_path / "e.ndjson").write_text("\n".join(lines))
    got = [(r.kind, r.type, r.error) for r in readers.read_events(spark, path).collect()]
    assert got == [("event", "stage", None), ("result", "result", None), ("web page", None, "<!DOCTYPE html><p>"), ("unreadable", None, "{broken"), ("error", "error", "no reason was given"), ("error", "error", "too long")]
    with pytest.raises(ValueError, match="web page"):
        readers.result_of(readers.read_events(spark, path))
    (tmp_path / "good").write_text("\n".join(lines[:3]))
    assert json.loads(readers.result_of(readers.read_events(spark, str(tmp_path / "good"))))["ok"]


def test_clean_faults(spark):
    rows = [("boom at https://a.example/x?k=1", "/p?x=1", "at f (/a.js?v=1:2:3)", None, "7.5", "x"), ("", "/p", "s", "s", "1", "1"), (None, "/p", "s", "s", "1", "1"), ("m" * 900, "else", None, "/s?t#u", "-2", "3")]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, f struct<message:string,route:string,stack:string,source:string,line:string,column:string>")
    got = {r.k: r.c for r in df.select("k", tx.clean_fault(F.col("f")).alias("c")).collect()}
    assert got[1] is None and got[2] is None
    assert got[0].asDict() == {"route": "/p", "message": "boom at https://a.example/x", "stack": "at f (/a.js:2:3)", "source": "", "line": 8, "column": 0}
    assert got[3].route == "/" and len(got[3].message) == 300 and got[3].source == "/s" and (got[3].line, got[3].column) == (0, 3)


def test_command_line(spark, tmp_path):
    (tmp_path / "a.txt").write_text("4 May 2021\n\nThe mill burnt down. " + "It was a long day, and a longer night. " * 8)
    store = ["--store", str(tmp_path / "s")]
    out = cli.run([*store, "index", str(tmp_path / "a.txt"), "--title", "Mill"], spark)
    assert out["added"] == 1 and len(out["doc_ids"]) == 1
    answer = cli.run([*store, "ask", out["doc_ids"][0], "What burnt down?"], spark)
    assert "mill" in answer["says"] and answer["refused_by"] is None
    assert cli.run([*store, "sample", "resume"], spark)["added"] == 1
