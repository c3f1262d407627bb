"""An ask computes each stage once; the index is pruned; stores of older schemas answer."""

from __future__ import annotations

import shutil
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from folioscan.operators import retrieval
from folioscan.plans.engine import Engine

DOCUMENT = "doc_id string, text string, title string, year_hint int, source_name string"
WORDS = "boiler river mill harbour ledger station orchard lantern quarry bridge".split()


def texts(n: int) -> list[tuple]:
    body = lambda k: "\n\n".join(f"{d + 1} May 20{k % 90 + 10}\nThe {WORDS[(k + d) % 10]} of house {k} was mended, and the {WORDS[(k * 3 + d) % 10]} was seen by Anna Brown in Lisbon." for d in range(6))
    return [(f"d{k}", body(k), f"House {k}", None, "x") for k in range(n)]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("once"))
    assert Engine(spark, at).add(spark.createDataFrame(texts(30), DOCUMENT))["added"] == 30
    return at


def test_models_are_called_once_over_all_panels(spark, path):
    counts = {k: spark.sparkContext.accumulator(0) for k in ("chat", "embed", "score")}

    @pandas_udf("string")
    def chat(p: pd.Series) -> pd.Series:
        counts["chat"].add(len(p))
        return pd.Series([f"WHAT THE DOCUMENT SAYS\nAnswer {hash(x)} {time.time_ns()}." for x in p])

    @pandas_udf("array<double>")
    def embed(t: pd.Series) -> pd.Series:
        counts["embed"].add(len(t))
        return pd.Series([[float(len(x) % 7), 1.0, *[0.0] * 62] for x in t])

    @pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        counts["score"].add(len(q))
        return t.str.len().astype(float)

    engine = Engine(spark, path, chat=lambda p: chat(p), embed=lambda t: embed(t), scorer=lambda q, t: score(q, t))
    asked = spark.createDataFrame([(1, "Where is the boiler?"), (2, "Who saw the lantern in Lisbon?"), (3, "What of the quarry?")], "question_id long, question string")
    panels = engine.ask(asked)
    said = {r.question_id: r.says for r in panels["replies"].collect()}
    for _ in range(2):
        for p in panels.values():
            p.collect()
        assert {r.question_id: r.says for r in panels["replies"].collect()} == said  # though the model never says the same twice
    assert counts["chat"].value == 3 and counts["embed"].value == 3
    assert counts["score"].value <= 3 * retrieval.CANDIDATES and panels["refused"].filter("refused_by IS NULL").count() == 3


def test_prompts_of_unscoped_questions_hold_facts_of_shown_documents_by_name(spark, path):
    engine = Engine(spark, path)
    asked = spark.createDataFrame([(1, "Where is the boiler of house 7?")], "question_id long, question string")
    panels = engine.ask(asked)
    shown = {r.doc_id for r in panels["shown"].collect()}
    prompt = engine.prompts(asked, panels["shown"], panels["sentences"], panels["coverage"]).first().prompt
    facts = prompt.split("NOTES")[0].splitlines()[1:]
    lines = [x for x in facts if "boiler" in x]
    assert 0 < len(lines) <= len(shown) <= retrieval.SHOWN and all(x.startswith("[House ") for x in lines)
    assert {x.split("]")[0][7:] for x in lines} <= {d[1:] for d in shown} and "You see 8 of 180 notes." in prompt
    assert {r.doc_id for r in panels["facts"].collect()} | {r.doc_id for r in panels["gaps"].collect()} <= shown


def test_an_ask_takes_seconds(spark, path):
    engine = Engine(spark, path)
    asked = spark.createDataFrame([(1, "Where is the boiler?")], "question_id long, question string")
    engine.ask(asked)["replies"].collect()  # compiles
    began = time.perf_counter()
    assert engine.ask(asked)["replies"].count() == 1
    assert time.perf_counter() - began < 10


def test_postings_are_pruned_by_slot_and_sorted_by_token(spark, path):
    engine = Engine(spark, path)
    index = engine.store.table("postings")
    slots = {r.slot for r in index.select("slot").distinct().collect()}
    asked = spark.createDataFrame([(1, "boiler")], "question_id long, question string")
    terms = retrieval.term_table(asked, expand=False).select(F.explode("phrase").alias("want"), "is_prefix").collect()
    wanted = [r.asDict() for r in terms]
    row = lambda d: type("W", (), {"want": d["want"], "open": d["is_prefix"]})()
    part = retrieval.of_terms(index, [row(d) for d in wanted])
    read = {r.f for r in part.select(F.input_file_name().alias("f")).distinct().collect()}
    every = {r.f for r in index.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(slots) > 5 and 0 < len(read) < len(every) / 3
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "slot" in plan.split("PartitionFilters")[1].split("]")[0] and "StringStartsWith(token,boiler)" in plan
    for f in every:
        tokens = [r.token for r in spark.read.parquet(f).select("token").collect()]
        assert tokens == sorted(tokens, key=lambda t: t.encode())


def test_the_whole_ranking_is_the_texts_own(spark, path):
    engine = Engine(spark, path)
    notes = engine.store.table("notes")
    asked = spark.createDataFrame([(1, "the boiler and the well-known river's quarry"), (2, "s"), (3, "an Anna b")], "question_id long, question string")
    rows = lambda df: sorted((r.question_id, r.note_id, round(r.score, 9)) for r in df.collect())
    assert rows(retrieval.bm25_indexed(engine.store.table("postings"), engine.store.table("sizes"), asked, depth=None)) == rows(retrieval.bm25(notes.select("note_id", "doc_id", "text"), asked, depth=None))


def test_a_store_without_postings_or_newer_columns_answers(spark, path, tmp_path):
    """Older batches lack a derived table, its entry in commits, and columns: they are made at read, once, and stored at compaction."""
    old = str(tmp_path / "old")
    shutil.copytree(path, old)
    for name in ("postings", "sizes"):
        shutil.rmtree(f"{old}/{name}")
    commits = spark.read.parquet(f"{path}/commits").drop("tables").collect()
    shutil.rmtree(f"{old}/commits")
    spark.createDataFrame(commits, "batch string, committed_at timestamp").write.parquet(f"{old}/commits")
    (batch,) = Path(f"{old}/notes").glob("batch=*")
    spark.read.parquet(f"{path}/notes/{batch.name}").drop("tokens").write.parquet(str(tmp_path / "n"))
    shutil.rmtree(batch)
    shutil.copytree(tmp_path / "n", batch)
    asked = spark.createDataFrame([(1, "Where is the boiler?")], "question_id long, question string")
    best = lambda e: [(r.note_id, r["rank"]) for r in e.ask(asked)["shown"].orderBy("rank").collect()]
    want, aged = best(Engine(spark, path)), Engine(spark, old)
    assert best(aged) == want
    # a new batch beside the old one: neither is counted twice
    aged.add(spark.createDataFrame([("new", "The boiler stood here for long. " * 10, "New", None, None)], DOCUMENT))
    assert aged.store.table("sizes").agg(F.sum("notes")).first()[0] == aged.store.table("notes").count() == 181
    assert aged.store.table("postings").select("note_id").distinct().count() == 181
    whole = Engine(spark, str(tmp_path / "compact"))
    aged.store.compact(whole.path)
    assert Path(f"{whole.path}/postings").exists() and best(whole) == best(aged)


def test_entries_are_computed_once_an_insert(spark, tmp_path, monkeypatch):
    from folioscan.operators import segment

    count = spark.sparkContext.accumulator(0)
    plain = segment.placed

    def placed(docs):
        def run(batches):
            for b in batches:
                count.add(b.num_rows)
                yield b

        return plain(docs.mapInArrow(run, docs.schema))

    monkeypatch.setattr(segment, "placed", placed)
    assert Engine(spark, str(tmp_path / "s")).add(spark.createDataFrame(texts(5), DOCUMENT))["added"] == 5
    assert count.value == 5


def test_known_documents_are_named(spark, path):
    engine = Engine(spark, path)
    again = [("other", texts(1)[0][1], "Again", None, None), ("fresh", "Nothing of this kind is stored. " * 10, None, None, None)]
    assert [tuple(r) for r in engine.known(spark.createDataFrame(again, DOCUMENT)).collect()] == [("other", "d0")]
    assert Engine(spark, path + "-none").known(spark.createDataFrame(again, DOCUMENT)).count() == 0
