from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import functions as F

from folioscan.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for k in range(len(words) - 4):
        at[tuple(words[k : k + 5])].append(k)
    covered = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = ["a b c d e a b c d e", "a a a a a a a", "x y z\nx y z\n\nx y z", "# a | b <c>", "one two three four five six seven one two three four five nine", "\x0b\x1c a\x85b", " ".join(f"w{k % 97}" for k in range(3000)), "é 😀 é"]


def test_measures_match_brute_force(spark, documents, odd):
    texts = TEXTS + [r.text for r in documents.collect()] + [r.text for r in odd.collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), texts[r.doc_id][:80]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.failed)


def test_good_documents_stay_and_junk_goes(spark):
    from folioscan.llm.queries import QUERIES

    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, "/root/testdata/sf0.01").collect()}
    good = [got[k] for k, q in labels.items() if q == 1]
    bad = [got[k] for k, q in labels.items() if q == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(r.kept for r in bad) <= 0.2 * len(bad)
    assert not any(r.kept and r.base_failed for r in got.values())


def test_one_projection(documents):
    plan = quality.judge(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty(empty):
    assert quality.judge(empty).count() == 0


def test_extra_columns_with_clashing_names(spark, odd):
    clash = odd.withColumn("m", F.lit("x")).withColumn("n_words", F.lit(-1)).withColumn("failed", F.lit(None).cast("string")).withColumn("kept", F.lit(7))
    assert sorted(map(str, quality.judge(clash).collect())) == sorted(map(str, quality.judge(odd).collect()))
