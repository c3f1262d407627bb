from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import toxicity
from folioscan.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_texts_are_told(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op13_toxicity"](spark, SF).collect()}
    assert set(got) == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(truth[k], r) for k, r in got.items() if r.held_out and k in truth]
    right = sum(y == 1 and r.predicted == 1 for y, r in held)
    assert right >= 0.85 * sum(y for y, _ in held)  # one text in twenty-five that is labelled toxic has no word that tells
    assert sum(y == 0 and r.predicted == 1 for y, r in held) <= 0.02 * len(held)
    order = np.argsort(np.argsort([r.score for _, r in held]))
    y = np.array([y for y, _ in held])
    assert (order[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum() >= 0.95


def test_labels_of_held_out_rows_and_other_columns_are_not_read(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = documents.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    scores = lambda docs, y: sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, y, epochs=2)).collect()))
    assert scores(documents, labels) == scores(other, flipped)


def test_scores_against_plain_loops(model):
    """Convolution, pooling and layer word by word, for short texts and texts in one block with others."""
    texts = ["", "hello", "you stupid idiot", "The house is on the hill. " * 4, "Das ist ein Haus und nicht mehr", None]
    net = model.network

    def plain(text):
        words = toxicity.words_of(text)
        vector = lambda w: sum((net.embedding[p].astype(float) for p in toxicity.pieces(w)), np.zeros(toxicity.DIMENSIONS)) / max(1, sum(p != toxicity.BUCKETS for p in toxicity.pieces(w)))
        vs = [vector(w) for w in words] or [np.zeros(toxicity.DIMENSIONS)]
        n = len(vs)
        vs += [np.zeros(toxicity.DIMENSIONS)] * 2
        pooled = [max(sum(vs[s + k] @ part[k, :, f] for k in range(len(part))) for s in range(n)) for part in net.filters for f in range(toxicity.FILTERS)]
        p = 1 / (1 + np.exp(-(np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.base)))
        cut = model.thresholds.get(toxicity.Language().tell(text), model.thresholds["und"])
        return 0.3 * p / cut if p < cut else 0.3 + 0.7 * (p - cut) / (1 - cut)

    assert np.allclose(model.scores(texts), [plain(t) for t in texts], atol=1e-4)


def test_blocks_change_nothing(model, documents, monkeypatch):
    texts = [r.text for r in documents.collect()]
    whole = model.scores(texts)
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 100)
    assert np.allclose(model.scores(texts), whole, atol=1e-6)
    assert np.allclose([model.scores([t])[0] for t in texts[:20]], whole[:20], atol=1e-6)


def test_a_word_anywhere_in_a_long_text_is_seen(model):
    clean = "the house and the garden in the evening of that day " * 3000
    low, high = model.scores([clean, clean + "you stupid worthless idiot " + clean])
    assert low < 0.3 <= high


def test_training_lowers_the_loss():
    """Loss over the texts learned from, after more and more steps."""
    texts = toxicity.Texts([["bad", "word", "here"], ["good", "word"], ["bad"], []] * 4)
    y = np.array([1, 0, 1, 0] * 4, np.float32)
    loss = lambda net: -np.mean(np.log(np.where(y == 1, net.scores(texts), 1 - net.scores(texts))))
    losses = [loss(toxicity.train(texts, y, np.arange(16), epochs=n)) for n in (1, 8, 60)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.1 < losses[0]


def test_thresholds_by_language():
    scores = np.array([0.9, 0.8, 0.7, 0.6] * 10 + [0.4, 0.3, 0.2, 0.1] * 10)
    labels = np.array([1, 1, 0, 0] * 20)
    langs = np.array(["aa"] * 40 + ["bb"] * 40, object)
    found = toxicity.thresholds_of(scores, labels, langs, 0.5)
    assert found["aa"] == pytest.approx(0.75) and found["bb"] == pytest.approx(0.25)
    assert set(toxicity.thresholds_of(scores[:44], labels[:44], langs[:44], 0.5)) == {"und", "aa"}


def test_languages():
    tell = toxicity.Language().tell
    assert [tell(t) for t in ("The end of the day", "Das Haus und der Garten", "la casa y el perro", "la maison et les jardins", "xyz", None)] == ["en", "de", "es", "fr", "und", "und"]


def test_edges(spark, odd, empty):
    labels = spark.createDataFrame([(k, k % 2, 1) for k in range(12)] + [(None, 1, 1), (1, 0, 1), (99, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    model = toxicity.fit(odd, labels, epochs=2)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1  # null, empty and blank texts are alike
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(empty, labels, epochs=1).scores(["a", None]).tolist() == pytest.approx([toxicity.fit(empty, labels, epochs=1).share] * 2)
    none = toxicity.fit(odd, labels.filter("toxic = 0"))
    assert none.scores(["x"]).tolist() == [0.0]
