from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.functions import text as tx
from folioscan.operators import segment


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_entities():
    assert tx.decode_text("&lt;b&gt; &AMP; &#65;&#x42; &copy; &#0; &#x110000; &nope; &amp;lt;") == "<b> & AB &copy; &#0; &#x110000; &nope; &lt;"


def test_html_becomes_text(spark):
    html = '<p>One<br>two</p><script>x("</p>")</script><!-- no --><ul><li>a</li><li>b</li></ul><table><tr><td>1</td><td>2</td></tr></table><img src="x.png"><h2>Head</h2>tail&nbsp;end'
    got = one(spark, tx.prepare(F.col("h")), h=html)
    assert "One\ntwo" in got and "x(" not in got and "no" not in got.split() and "[image]" in got and "· 1" in got and got.endswith("tail end")
    assert one(spark, tx.prepare(F.col("h")), h="a < b and c\r\n\r\n\r\n\r\nd  ") == "a < b and c\n\nd"


def test_titles(spark):
    cases = {"\n\n## **Hello** \nx": "Hello", "ab\nlong enough": "long enough", "": "Untitled document", "y" * 95: "y" * 87 + "…"}
    for text, want in cases.items():
        assert one(spark, tx.guess_title(F.col("t")), t=text).strip("*") == want


def test_images_follow_the_document():
    text = '![a](/one.png) then <img alt="B" src="two.jpg"> http://x.org/one.gif. and ![](http://x.org/one.gif "late")'
    assert tx.find_images(text, "http://base.org/p/") == [("http://base.org/one.png", "a"), ("http://base.org/p/two.jpg", "B"), ("http://x.org/one.gif", "late")]


def test_headings(spark):
    for line, want in {"Summary": True, "A sentence.": False, "# any title!": False, "# any title": True, "lower case": False, "W" * 81: False, "Costs:": True, "One two three four five six seven eight nine ten eleven": False}.items():
        assert one(spark, tx.is_heading_candidate(F.col("t")), t=line) is want, line
    assert one(spark, tx.clean_heading(F.col("t")), t="## **Terms**:") in ("Terms", "Terms**")


def test_stack_frames_and_redaction(spark):
    stack = "Error: x\n  at f (http://a/b.js?t=1:10:5)\n  at async g (c.js:2:3)\n  at h.js:7:8\n  at nowhere"
    frames = one(spark, tx.stack_frames(F.col("s")), s=stack)
    assert [(f.method, f.lineno, f.colno) for f in frames] == [("", 7, 8), ("g", 2, 3), ("f", 10, 5)]
    assert one(spark, tx.redact_urls(F.col("s"), 200), s="see http://a.org/p?q=1#z and (/x/y?k=2) at http://a.org/b.js?v=2:3:4") == "see http://a.org/p and (/x/y) at http://a.org/b.js:3:4"


DIARY = "3 March 2025\n\nThe pipes froze again. It was cold.\n\n9 March 2025\n\nA plumber came.\n\n"


def test_entries(spark):
    docs = spark.createDataFrame([("d", DIARY), ("f", "one\n\ntwo\n\nthree\n\nfour\n\nfive"), ("n", None), ("e", "")], "doc_id string, text string")
    rows = segment.entries(docs).orderBy("doc_id", "idx").collect()
    assert [(r.doc_id, r.date, r.month) for r in rows] == [("d", "2025-03-03", "2025-03"), ("d", "2025-03-09", "2025-03"), ("f", None, None)]
    assert rows[0].heading == "3 March 2025" and rows[0].text.startswith("3 March 2025\n\nThe pipes")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!", max_size=600))
def test_pieces_of_an_entry_join_to_it(text):
    assert "".join(segment.split_runs(text)) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "and.", "x!", "longer-word"]), min_size=1, max_size=900))
def test_notes_cover_every_word(words):
    text = " ".join(words)
    notes = segment.cut_notes(text)
    assert notes[0][1] == 0 and all(text[a:b] == t for t, a, b in notes)
    assert all(b[1] <= a[2] for a, b in zip(notes, notes[1:], strict=False))
    assert all(len(t.split()) <= segment.WINDOW + segment.REACH for t, *_ in notes)


def test_long_runs_of_lines_are_cut_evenly():
    lines = [f"line {k}" for k in range(25)]
    pieces = segment.split_runs("\n".join(["head", "", *lines]))
    assert [p.count("line") for p in pieces if "line" in p] == [9, 9, 7]
    assert segment.split_runs("\n".join(lines[:11])) == ["\n".join(lines[:11])]
