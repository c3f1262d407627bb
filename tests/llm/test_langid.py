from __future__ import annotations

import base64
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from folioscan.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert set(got) == set(truth)
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.lang_pred in {"en", "fr", "de", "es"}
    held = [k for k in got if got[k].held_out]
    assert sum(got[k].lang_pred == truth[k] for k in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in got.values()) <= 0.01 * len(got)


def test_labels_of_held_out_rows_and_other_columns_are_not_read(documents):
    wrong = documents.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.col("lang"))
    a = sorted(map(tuple, langid.identify_all(documents).collect()))
    assert a == sorted(map(tuple, langid.identify_all(wrong).collect()))


def test_counts_are_the_same_in_chunks(monkeypatch):
    text = "Éric's café, où l'on boit; and THE end… " * 30
    whole = langid.counts(text)
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(langid, "_CHUNK", size)
        assert np.array_equal(langid.counts(text), whole)


def test_edges(odd, empty, documents):
    got = langid.identify_all(odd).collect()
    assert len(got) == odd.count()
    model = langid.fit(documents)
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 and rows[k].rejected for k in (0, 1, 2))
    assert rows[5].lang_pred != "und"
    assert langid.identify_all(empty).count() == 0
    assert all(p[0] == "und" for p in langid.UNTAUGHT.predict(["text", None]))
    assert all(model.predict(["漢字" * 400])[0][k] == v for k, v in ((2, True),))  # unlike all it knows
    out = langid.keep_identified(documents)
    assert out.columns == documents.columns and out.count() >= 0.99 * documents.count()


def plain_counts(text: str) -> Counter:
    """N-grams of one to three characters: letters as they are, all else a gap; gaps count once and alone not."""
    points = [32 if ord(c) < 65 or 90 < ord(c) < 97 or 122 < ord(c) < 192 else ord(c) for c in text.lower()]
    out = Counter()
    for n in (1, 2, 3):
        for k in range(len(points) - n + 1):
            gram = points[k : k + n]
            if gram[0] == 32 and (n == 1 or gram[1] == 32):
                continue
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for point in gram:
                h = (h ^ point) * 0x01000193 & 0xFFFFFFFF
            out[(h ^ (h >> 15)) % langid.DIMENSIONS] += 1
    return out


def test_vectors_centroids_and_predictions_against_plain_sums(documents):
    """Frequencies, TF-IDF, cosines and the nearest centroid, by dictionaries and loops; centroids are means of their members."""
    per = 12
    model = langid.fit(documents, per_language=per)
    rows = [r for r in documents.filter(~langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))).collect()]
    taught = {lang: [r.text for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r.u)[:per]] for lang in {r.lang for r in rows}}
    grams = {lang: [plain_counts(t) for t in texts] for lang, texts in taught.items()}
    n, df = sum(map(len, grams.values())), Counter(d for own in grams.values() for g in own for d in g)

    def vector(g):
        x = {d: math.log1p(c) * (math.log((1 + n) / (1 + df[d])) + 0.1) for d, c in g.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {d: v / norm for d, v in x.items()}

    cosine = lambda x, c: sum(v * c[d] for d, v in x.items())
    assert sorted(set(model.languages)) == sorted(taught) and set(model.languages) == {"en", "fr", "de", "es"}
    for lang, own in grams.items():
        mine = [c for c, name in zip(model.centroids, model.languages, strict=True) if name == lang]
        vectors = [vector(g) for g in own]
        to = [max(range(len(mine)), key=lambda j: cosine(x, mine[j])) for x in vectors]
        for j, c in enumerate(mine):
            total = np.zeros(langid.DIMENSIONS)
            for x in (x for x, t in zip(vectors, to, strict=True) if t == j):
                for d, v in x.items():
                    total[d] += v
            assert np.allclose(c, total / np.linalg.norm(total), atol=1e-4)
    got = {r.doc_id: r for r in langid.identify(documents, model).collect()}
    for r in documents.filter("doc_id % 3 = 0 AND length(text) BETWEEN 1 AND 8000").collect():
        cosines = [cosine(vector(plain_counts(r.text)), c) for c in model.centroids]
        if got[r.doc_id].lang_pred == "und":
            continue
        assert abs(got[r.doc_id].score - max(cosines)) < 1e-5 and cosines[model.languages.index(got[r.doc_id].lang_pred)] >= 0 and max(cosines) - max(c for c, name in zip(cosines, model.languages, strict=True) if name == got[r.doc_id].lang_pred) < 1e-5


def test_junk_of_any_length_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    draw = random.Random(3)
    junk = lambda n: " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 10))) for _ in range(n))
    texts = [junk(n) for n in (50, 300, 1000, 3000, 10_000)] + [base64.b64encode(draw.randbytes(n)).decode() for n in (300, 3000, 30_000)] + ["漢字" * n for n in (3, 400, 20_000)] + ["Ελληνικά λόγια και άλλα τέτοια " * n for n in (5, 500)]
    assert all(rejected for _, _, rejected in model.predict(texts)), model.predict(texts)


def test_every_label_is_learned_and_too_many_are_an_error(spark, monkeypatch):
    rows = [(k, f"{chr(0x4E00 + k % 40)}{chr(0x5E00 + k % 40)} " * 20, f"l{k % 40}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(set(langid.fit(docs).languages)) == 40
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 39)
    with pytest.raises(ValueError):
        langid.fit(docs)


def test_equal_cosines_take_the_first_language(spark):
    docs = spark.createDataFrame([(k, "the same words in both", "ab"[k % 2] * 2) for k in range(60)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify_all(docs).collect()} == {"aa"}
