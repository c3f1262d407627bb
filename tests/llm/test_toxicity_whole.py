"""All labelled texts are learned from, however long and many."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from folioscan.llm import toxicity


def texts(spark, n, bad, length=1):
    words = "the house and garden of evening light upon river stone under green water with paper boats".split()
    said = lambda k: " ".join(words[(k * 7 + j * (k % 5 + 1)) % len(words)] for j in range(12))
    rows = [(k, " ".join([said(k)] * length) + (f" {bad} {said(k + 1)}" if k % 2 else "")) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(n)], "doc_id long, toxic int")


def test_long_texts_are_learned_from(spark):
    docs, labels = texts(spark, 80, "grimblewort", 720)
    assert docs.selectExpr("min(length(text))").first()[0] > 40_000
    low, high = toxicity.fit(docs, labels).scores(["the house and garden of evening light", "the house and grimblewort garden of evening light"])
    assert low < 0.3 <= high


@pytest.mark.parametrize("first", [60, 4000])
def test_texts_of_several_parts(spark, monkeypatch, first):
    """Of parts (with FIRST at 60) or at once: a word that some 45 texts hold, none of the first part or few, tells."""
    monkeypatch.setattr(toxicity, "FIRST", first)
    monkeypatch.setattr(toxicity, "PART", 100)
    docs, labels = texts(spark, 600, "grimblewort")
    fit = lambda: toxicity.fit(docs, labels)
    model = fit()
    assert model.share == pytest.approx(0.5, abs=0.05)
    held = [r.text for r in docs.filter(toxicity.held_out(docs.doc_id)).orderBy("doc_id").collect()]
    scores = model.scores(held)
    assert all((s >= 0.3) == ("grimblewort" in t) for s, t in zip(scores, held, strict=True))
    assert fit().scores(held).tolist() == pytest.approx(scores.tolist(), abs=1e-4)


def test_openings_and_endings_are_hashed_once(monkeypatch):
    """Words that share them, in several blocks: each word costs a hash, not one for each piece; the buckets are those of each piece by itself."""
    words = [f"vorhaben{chr(97 + i)}{chr(97 + j)}ung" for i in range(20) for j in range(20)] + ["é", "ab", "Straße", "\ud800x", "naïveté"]
    calls, crc = [0], zlib.crc32

    def counted(raw):
        calls[0] += 1
        return crc(raw)

    monkeypatch.setattr(toxicity.zlib, "crc32", counted)
    made = [toxicity.Texts([words]) for _ in range(3)]
    assert calls[0] < 4 * len(words)
    raw = lambda w: w.encode("utf-8", "surrogatepass")
    for texts in made:
        for w, row in zip(texts.words, texts.pieces[1:].tolist(), strict=True):
            heads = [crc(b"^" + raw(w[:n])) % toxicity.BUCKETS if len(w) >= n else toxicity.BUCKETS for n in toxicity.OPENINGS]
            tails = [crc(b"$" + raw(w[-n:])) % toxicity.BUCKETS if len(w) >= n else toxicity.BUCKETS for n in toxicity.ENDINGS]
            assert row == [crc(raw(w)) % toxicity.BUCKETS, *heads, *tails]
        assert texts.ids[: len(words)].tolist() == list(range(1, len(words) + 1)) and np.all(texts.pieces[0] == toxicity.BUCKETS)


def test_hits_are_a_row_a_word():
    language = toxicity.Language()
    none = np.zeros(len(language.names), np.int64)
    words = ["the", "boiler", "de", "der", "la", "xyz"]
    assert language.hits(words).tolist() == [language.of.get(w, none).tolist() for w in words]
    assert language.hits([]).shape == (0, len(language.names))


def test_words_are_runs_of_letters_in_any_script():
    every = "".join(map(chr, range(256)))
    for text in (every, every + "—“ŒœŠš” Ωmega", "İstanbul ǅ straße's x²y a\x85b\xa0c", "", "12 _ 3", "日本語 text ª º µ"):
        assert toxicity.words_of(text) == toxicity._WORD.findall(text.lower())
    assert toxicity.words_of(None) == []


def test_words_of_a_block_are_hashed_together(monkeypatch):
    """No call a word; the buckets of words of several lengths, scripts and lone surrogates are still zlib's."""
    words = [f"{chr(97 + i)}{chr(0xE0 + j)}wort{chr(0x4E00 + k)}" for i in range(10) for j in range(20) for k in range(20)] + ["a", "ab", "abc", "\ud800", "𝔸b"]
    crc, calls = zlib.crc32, []
    monkeypatch.setattr(toxicity.zlib, "crc32", lambda raw: calls.append(raw) or crc(raw))
    texts = toxicity.Texts([words, [], words[::-1]])
    assert len(calls) < 100 and texts.words == words
    assert [crc(w.encode("utf-8", "surrogatepass")) % toxicity.BUCKETS for w in words] == texts.pieces[1:, 0].tolist()
    last = texts.start[2]
    assert texts.size.tolist() == [len(words), 1, len(words)] and texts.ids[last : last + len(words)].tolist() == list(range(len(words), 0, -1))
    assert texts.ids[len(words) : last].tolist() == [0] * (2 + 1 + 2) and texts.ids[-4:].tolist() == [0] * 4


def test_only_documents_with_a_label_are_shuffled(spark):
    """All documents that have a label are kept, and few others; those alone meet their labels."""
    docs = spark.range(20_000).selectExpr("id - 7 as doc_id", "'some text' as text")
    labels = spark.range(0, 20_000, 10).selectExpr("id as doc_id", "1 as label")
    there = toxicity._with_bit(docs, labels, 2000)
    assert there.join(labels, "doc_id").count() == 2000
    assert 2000 <= there.count() < 4000 and there.columns == docs.columns
