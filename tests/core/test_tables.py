"""Operators that no SQL says, against literal tables and plain computations."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import functions as F

from folioscan import plans
from folioscan.operators import retrieval, segment
from folioscan.operators import timeline as tl
from folioscan.plans import corpora, search_queries

SF = "/root/testdata/sf0.001"
QUERIES, _ = plans.load()

DIARY = """3 March 2025

The pipes froze.

9 March

A plumber came.
He stayed.

EXPERIENCE

Fitter, North Works
May 2019 to Present
Keeps presses running.

Apprentice, Quay Yard
January 2016 to April 2019
Learned to weld."""


def test_entries(spark):
    docs = spark.createDataFrame([(1, DIARY), (2, ""), (3, None), (4, "One block only, 6/3/2026 unclear.")], "doc_id long, text string")
    rows = segment.entries(docs).orderBy("doc_id", "idx").collect()
    for r in rows:
        text = DIARY if r.doc_id == 1 else "One block only, 6/3/2026 unclear."
        assert re.sub(r"\n\s*\n", "\n\n", text[r.start : r.end]) == r.text
    got = [(r.doc_id, r.idx, r.heading, r.date, r.month, r.end_month, r.open_ended, r.inferred, r.ambiguous) for r in rows]
    assert got == [
        (1, 0, "3 March 2025", "2025-03-03", "2025-03", None, False, False, False),
        (1, 1, "9 March", "2019-03-09", "2019-03", None, False, True, False),  # the year that the text names most
        (1, 2, "EXPERIENCE", None, None, None, False, False, False),
        (1, 3, "Fitter, North Works", None, "2019-05", None, True, False, False),
        (1, 4, "Apprentice, Quay Yard", None, "2016-01", "2019-04", False, False, False),
        (4, 0, None, None, None, None, False, False, True),
    ]


def plain_notes(text):
    """Windows of 220 words, ended at a sentence within 60 more, the next one 40 words back."""
    spans = [m.span() for m in re.finditer(r"[\w'’-]+", text.replace("_", " "))]
    if len(spans) <= 220:
        return [text]
    out, at = [], 0
    while True:
        end = min(at + 220, len(spans))
        if end < len(spans):
            for k in range(end, min(end + 60, len(spans))):
                if any(c in text[spans[k - 1][1] : spans[k][0]] for c in ".!?"):
                    end = k
                    break
        out.append(text[spans[at][0] : spans[end][0] if end < len(spans) else spans[-1][1]].strip())
        if end == len(spans):
            return out
        at = max(at + 1, end - 40)


def test_notes(spark):
    sentences = " ".join(f"Word{k} and more of it{'.' if k % 13 == 0 else ''}" for k in range(300))
    texts = {1: sentences, 2: "short one", 3: "no stop " * 400, 4: "\n".join(f"line {k} of a list" for k in range(25))}
    rows = spark.createDataFrame([(k, 0, f"Head {k}" if k == 1 else None, "2024-05-06" if k == 2 else None, None, t) for k, t in texts.items()], "doc_id long, idx int, heading string, date string, date_raw string, text string")
    got = defaultdict(list)
    for r in segment.notes(rows).orderBy("doc_id", "part").collect():
        got[r.doc_id].append(r)
        assert r.words == len(re.findall(r"[\w'’-]+", r.text))
    assert all(r.parts == len(own) and r.part == k for own in got.values() for k, r in enumerate(own))
    assert [r.text for r in got[1]] == plain_notes(texts[1]) and [r.text for r in got[3]] == plain_notes(texts[3])
    assert [r.heading for r in got[1]] == ["Head 1"] + [None] * (len(got[1]) - 1) and got[1][1].label == f"Head 1 (2/{len(got[1])})"
    assert [(r.text, r.label) for r in got[2]] == [("short one", "2024-05-06")]
    assert [r.text.count("line") for r in got[4]] == [9, 9, 7]  # 25 lines in three equal groups


def test_lone_names(spark):
    found = {(r.conv_id, r.name) for r in QUERIES["lone_names"](spark, SF).collect()}
    said = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    assert {c for c, name in found if name == "Marita"} == {c for c, _ in found} and len({c for c, _ in found}) == said
    from folioscan.operators.entities import lone_names

    texts = ["We rang Petra at noon. Later Petra came.", "Petra came. Petra left.", "We saw Lisbon there. Then Lisbon was warm.", "we met Omar then. And Omar Khan said so.", "so Ida wrote, and then Ida slept; that Ida woke."]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r.n for r in df.select("k", F.array_distinct(lone_names(F.col("text"), F.array().cast("array<string>"))).alias("n")).collect()}
    assert got == {0: ["Petra"], 1: [], 2: [], 3: [], 4: ["Ida"]}


def test_span_lanes(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    spans = defaultdict(list)
    for r in tl.spans(corpora.jobs(read).select("doc_id", "idx", "label", "month", "end_month", "open_ended")).collect():
        spans[r.doc_id].append(r)
    want = {}
    for doc_id, rows in spans.items():
        lanes: list[str] = []
        bars = [r for r in sorted(rows, key=lambda r: r.idx) if not r.point]
        for r in bars:
            at = next((k for k, end in enumerate(lanes) if end < r.from_month), len(lanes))
            lanes[at : at + 1] = [r.to_month]
            want[doc_id, r.idx] = at
        want |= {(doc_id, r.idx): len(bars) for r in rows if r.point}
    got = {(r.doc_id, r.idx): r.lane for r in QUERIES["span_lanes"](spark, SF).collect()}
    assert got == want


def test_image_references(spark):
    got = defaultdict(list)
    for r in QUERIES["image_references"](spark, SF).orderBy("page_id", "pos").collect():
        got[r.page_id].append((r.url, r.caption))
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert set(got) == set(pages)
    for page_id, found in got.items():
        assert {("http://a.example/c.png", "chart"), ("/z.jpg", "A & B")} <= set(found) and len(dict(found)) == len(found), found
        own = re.findall(r"<img[^>]*src=[\"']([^\"']+)", pages[page_id])
        assert set(own) <= {u for u, _ in found}


def test_rerank_overlap(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    fused = retrieval.fuse(search_queries.other_ranking(read), search_queries.word_ranking(read)).filter(F.col("rank") <= retrieval.CANDIDATES).collect()
    texts = {r.note_id: r.text for r in search_queries.diary_notes(read).collect()}
    asked = dict(search_queries.ASKED)
    words = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
    by = defaultdict(list)
    for r in fused:
        by[r.question_id].append((-len(words(asked[r.question_id]) & words(texts[r.note_id])), r.rank, r.note_id))
    want = {(q, note, k + 1) for q, rows in by.items() for k, (_, _, note) in enumerate(sorted(rows)[: retrieval.SHOWN])}
    assert {(r.question_id, r.note_id, r["rank"]) for r in QUERIES["rerank_overlap"](spark, SF).collect()} == want


def test_approx_terms(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()
    exact = defaultdict(set)
    for r in texts:
        exact[r.lang] |= set(re.findall(r"[^\W\d_]+", (r.text or "").lower()))
    for r in QUERIES["approx_terms"](spark, SF).collect():
        assert abs(r.words - len(exact[r.lang])) <= 0.15 * len(exact[r.lang]) + 2
