"""Mentions, long pages, vectors, embedding requests, files that hang, logs and states of streams, evaluation: each by value."""

from __future__ import annotations

import datetime
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from folioscan.functions import dates
from folioscan.functions import vectors as vx
from folioscan.operators import admission, entities, evaluation, retrieval, segment
from folioscan.plans.engine import Engine
from folioscan.sources import readers
from folioscan.streaming import ingest, limits


def test_matcher_against_patterns():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcAÉé_-'. ") for _ in range(draw.randint(1, 5)))
    for _ in range(300):
        values = [word() for _ in range(6)]
        text = "".join(draw.choice("abcABCÉé_-'. ") for _ in range(80))
        want = {k for k, v in enumerate(values) if v and re.search(rf"(?<![A-Za-z0-9_])(?:{''.join(f'[{c.lower()}{c.upper()}]' if c.isascii() and c.isalpha() else re.escape(c) for c in v)})(?![A-Za-z0-9_])", text)}
        assert entities.matcher(values)(text) == want, (values, text)


def test_mentions_of_many_values_take_one_pass(spark):
    values = spark.range(5000).selectExpr("1L AS doc_id", "'place' AS kind", "concat('Place', id) AS value")
    pieces = spark.range(3000).selectExpr("1L AS doc_id", "cast(id AS int) AS idx", "concat('We saw place', id, ' and PLACE', id + 1, ', not Place', id, 'x.') AS text")
    began = time.perf_counter()
    got = {(r.idx, r.value) for r in entities.mentions_in(pieces, values).collect()}
    assert got == {(k, f"Place{k + j}") for k in range(3000) for j in (0, 1)} and time.perf_counter() - began < 30
    assert entities.mentions_in(pieces.limit(0), values).count() == 0


def test_a_page_of_very_many_blocks(spark):
    blocks = [f"{k % 28 + 1} May {1990 + k % 30}\nIt rained on day {k}." if k % 3 == 0 else f"Block {k} goes on." for k in range(100_000)]
    docs = spark.createDataFrame([(1, "\n\n".join(blocks)), (2, None), (3, " \n \n "), (4, "\n\nlead\n \t\n\ntail\n\n")], "doc_id long, text string")
    began = time.perf_counter()
    r = segment.entries(docs).filter("doc_id = 1").agg(F.count("*").alias("n"), F.count("date").alias("dated"), F.max("end").alias("end"), F.sum(F.length("text")).alias("chars")).first()
    assert (r.n, r.dated, r.end) == (33_334, 33_334, len("\n\n".join(blocks))) and r.chars == len("\n\n".join(blocks)) - 2 * 33_333
    assert time.perf_counter() - began < 60
    assert [(x.doc_id, x.text, x.start, x.end) for x in segment.blocks(docs).filter("doc_id > 1").orderBy("start").collect()] == [(4, "lead", 2, 6), (4, "tail", 11, 15)]
    assert [(x.line, x.text, x.start) for x in segment.lines(spark.createDataFrame([(1, 0, "a\n\nbc", 5)], "doc_id long, pos int, text string, start int")).collect()] == [(0, "a", 5), (1, "", 7), (2, "bc", 8)]


def test_very_many_dates_in_one_text():
    text = " ".join(f"{k % 28 + 1} May 2020," for k in range(20_000)) + " May 2020 to June 2021"
    began = time.perf_counter()
    hits = dates.find_dates(text)
    assert len(hits) == 20_002 and all(a.start < b.start for a, b in zip(hits, hits[1:], strict=False))
    assert dates.period_of(text, hits) == ("2021-06", False) and time.perf_counter() - began < 20


def test_vectors_in_blocks_rank_as_pair_by_pair(spark):
    draw = random.Random(1)
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    notes = [(k, unit([draw.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(7)] + [0.5])) for k in range(900)] + [(1000 + k, unit([1.0] * 8)) for k in range(200)]
    asked = [(q, unit([draw.choice([-1.0, 1.0, 3.0]) for _ in range(8)])) for q in range(5)] + [(9, unit([1.0] * 8))]
    v = spark.createDataFrame(notes, "note_id long, v array<double>").repartition(5)
    q = spark.createDataFrame(asked, "question_id long, q array<double>")
    want = {}
    for i, x in asked:
        best = sorted((-round(sum(a * b for a, b in zip(x, y, strict=True)), 9), n) for n, y in notes)[:60]
        want |= {(i, n): r + 1 for r, (_, n) in enumerate(best)}
    got = retrieval.cosine_ranking(v, q)
    assert {(r.question_id, r.note_id): r["rank"] for r in got.collect()} == want
    assert retrieval.cosine_ranking(v.limit(0), q).count() == 0 and retrieval.cosine_ranking(v, q.limit(0)).count() == 0


def test_vectors_of_another_width_are_an_error_with_a_reason(spark):
    q = spark.createDataFrame([(1, [1.0] * 64)], "question_id long, q array<double>")
    with pytest.raises(Exception, match="a vector has 63 values, the questions have 64"):
        retrieval.cosine_ranking(spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 63)], "note_id long, v array<double>"), q).collect()
    with pytest.raises(ValueError, match="different widths"):
        retrieval.cosine_ranking(spark.createDataFrame([(1, [1.0] * 64)], "note_id long, v array<double>"), q.union(spark.createDataFrame([(2, [1.0])], q.schema)))


def test_embedding_requests(spark):
    texts = spark.range(100).selectExpr("id", "repeat('x', cast(id AS int)) AS t").repartition(3)
    done = spark.sparkContext.accumulator(0)

    def shuffles(part):
        assert len(part) <= 16
        order = list(range(len(part)))
        random.Random(len(part)).shuffle(order)
        return [(k, [3.0 * len(part[k]), 4.0 * len(part[k])]) for k in order]

    got = texts.select("id", vx.batched_embedder(shuffles, 16, 2, done)(F.col("t")).alias("v")).collect()
    assert all(r.v == pytest.approx([0.6, 0.8] if r.id else [0, 0]) for r in got) and done.value == 100
    for bad, why in ((lambda part: shuffles(part)[1:], "got"), (lambda part: [(0, [1.0])] * len(part), "twice"), (lambda part: [(k, [1.0] * (1 + k)) for k in range(len(part))], "different widths"), (lambda part: [(k, [1.0]) for k in range(len(part))], "different widths")):
        with pytest.raises(Exception, match=why):
            texts.select(vx.batched_embedder(bad, 16, 2)(F.col("t"))).collect()


def test_a_file_that_hangs_is_refused_and_the_rest_go_on(spark, tmp_path):
    for k, body in enumerate((b"fine", b"hang", b"dies", b"raises", b" ", b"also fine")):
        (tmp_path / f"{k}.pdf").write_bytes(b"%PDF-" + body)

    def extract(data: bytes) -> str:
        import os
        import time

        if data.endswith(b"hang"):
            time.sleep(600)
        if data.endswith(b"dies"):
            os._exit(9)
        if data.endswith(b"raises"):
            raise ValueError("no pages")
        return data[5:].decode()

    began = time.perf_counter()
    got = {r.source_name[-5]: (r.text, r.reason) for r in readers.read_pdfs(spark, str(tmp_path), extract, seconds=3).collect()}
    assert time.perf_counter() - began < 60
    assert got["0"] == ("fine", None) and got["5"] == ("also fine", None) and "within 3 seconds" in got["1"][1] and "broke down" in got["2"][1] and "no pages" in got["3"][1] and "no text" in got["4"][1]
    assert readers.guarded(readers.by_command("tr", "a-z", "A-Z"), b"abc") == "ABC"
    with pytest.raises(readers.Unreadable):
        readers.guarded(readers.by_command("false"), b"")


def test_stream_progress_as_lines_that_the_reader_reads(spark, tmp_path):
    log = ingest.ProgressLog(spark, str(tmp_path / "log"))
    spark.range(10).write.parquet(str(tmp_path / "in"))
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        stream.writeStream.format("noop").queryName("logged").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        events = None
        for _ in range(60):
            time.sleep(0.5)
            if (tmp_path / "log").exists() and (events := readers.read_events(spark, str(tmp_path / "log"))).filter("kind = 'result'").count():
                break
    finally:
        spark.streams.removeListener(log)
    lines = [json.loads(r.line) for r in events.filter("kind = 'event'").collect()]
    assert sum(x.get("rows", 0) for x in lines) == 10 and {x["stage"] for x in lines} == {"started", "batch"}
    assert json.loads(readers.result_of(events))["ended"]


def test_states_of_limits_fall_after_their_windows(spark, tmp_path):
    """Windows of 20 s over keys that come once: with a lateness, what is kept follows the active keys, and decisions are the table's."""
    rows = [(f"k{k // 4}", 1_000_000 + 1000 * k, k, 10 * (k % 9)) for k in range(400)]
    events = spark.createDataFrame(rows, "key string, at long, seq long, amount long")
    want = sorted((r.seq, r.allowed, r.used, r.wait_ms) for r in admission.decide(events, "requests", 2, 20_000).collect())
    for part in range(10):
        events.filter(F.col("seq").between(part * 40, part * 40 + 39)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    kept = {}
    for lateness in (None, "1 second"):
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        name = "kept_all" if lateness is None else "kept_some"
        query = limits.limit_stream(source, "requests", 2, 20_000, lateness).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        kept[lateness] = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        assert sorted((r.seq, r.allowed, r.used, r.wait_ms) for r in spark.table(name).collect()) == want
    assert kept[None] == 100 and kept["1 second"] < 30


def test_sweeps(spark, tmp_path):
    engine, gone = Engine(spark, str(tmp_path / "s")), []
    docs = readers.samples(spark).withColumn("year_hint", F.lit(None).cast("int")).withColumn("source_name", F.lit("x"))
    engine.add(docs)
    purge = engine.store.purge
    engine.store.purge = lambda now: purge(now + datetime.timedelta(days=3))
    query = ingest.sweep(spark, engine.store, str(tmp_path / "c"), "1 second", lambda k, n: gone.append(n))
    try:
        for _ in range(120):
            if len(gone) > 1:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert gone[0] == 2 and sum(gone) == 2 and engine.store.table("documents").count() == 0


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, ["(?i)boiler", r"\b2 times"], ["(?i)four"], False), (2, [], None, True), (3, None, ["x"], None)], "case_id int, must array<string>, must_not array<string>, refuse boolean")
    replies = spark.createDataFrame([(1, 0, "The Boiler, 2 times.", False), (1, 1, "The boiler, four times.", False), (1, 2, None, True), (2, 0, None, True), (2, 1, "It says so.", False), (3, 0, None, None), (9, 0, "x", False)], "case_id int, run int, reply string, refused boolean")
    judged = evaluation.judge(cases, replies)
    got = {(r.case_id, r.run): (r.passed, list(r.missing), list(r.forbidden), r.wrongly_refused, r.wrongly_answered) for r in judged.collect()}
    assert got == {
        (1, 0): (True, [], [], False, False), (1, 1): (False, [r"\b2 times"], ["(?i)four"], False, False), (1, 2): (False, [], [], True, False),
        (2, 0): (True, [], [], False, False), (2, 1): (False, [], [], False, True), (3, 0): (True, [], [], False, False),
    }
    assert {tuple(r) for r in evaluation.stability(judged).collect()} == {(1, 3, 1, False), (2, 2, 1, False), (3, 1, 1, True)}
    items = spark.createDataFrame([(1, "Boiler"), (1, "four"), (1, "four"), (2, "a"), (1, None)], "case_id int, item string")
    assert {(r.case_id, r.run): (r.named, r.needed, list(r.left_out)) for r in evaluation.completeness(replies, items).collect()} == {(1, 0): (1, 2, ["four"]), (1, 1): (2, 2, []), (1, 2): (0, 2, ["Boiler", "four"]), (2, 0): (0, 1, ["a"]), (2, 1): (1, 1, [])}
    floor = lambda rows: tuple(evaluation.refusal_floor(spark.createDataFrame(rows, "noise boolean, best double")).first())
    assert floor([(True, 0.3), (True, 0.5), (False, 0.7), (False, 0.9)]) == (0.5, 0.7, pytest.approx(0.6)) and floor([(True, 0.8), (False, 0.7)]) == (0.8, 0.7, None) and floor([(True, 0.8)]) == (0.8, None, None)
