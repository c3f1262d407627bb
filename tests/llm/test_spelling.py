from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from folioscan.llm import spelling
from folioscan.llm.queries import QUERIES

SMOKE = "/root/testdata/sf0.001"


def plain_near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_counts(rows) -> dict[str, int]:
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def plain_variants(n: dict[str, int]) -> set[tuple]:
    near = {w: [] for w in n}
    # words at distance one share what is left when a letter of each is dropped, or one of them is that
    left = {}
    for w in n:
        for k in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            left.setdefault(k, set()).add(w)
    for w in n:
        others = set().union(*(left.get(k, ()) for k in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}))
        near[w] = [x for x in others if plain_near(w, x)]
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def test_whole_table_against_plain_variants(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op11_spelling_variants"](spark, sf).select(COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(plain_counts(rows))


def test_small_shards_and_waves_change_nothing(spark, monkeypatch):
    draw = random.Random(6)
    counts = {}
    for _ in range(120):
        w = "".join(draw.choice("abé") for _ in range(draw.randint(6, 9)))
        counts[w] = draw.choice([5, 6, 30, 30, 200, 1500])
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    expected = plain_variants(counts)
    for limits in ({}, {"shard_words": 7, "wave_bytes": 300}, {"shard_words": 1, "wave_bytes": 2500}):
        assert {tuple(r) for r in spelling.spelling_variants(words, **limits).select(COLUMNS).collect()} == expected
    assert any(r[3] and r[5] != r[3] for r in expected)  # forms of forms


def test_automata_against_plain_distance(monkeypatch):
    draw = random.Random(7)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randint(1, 8)))
    for trial in range(150):
        letters = draw.choice(["ab", "abc", "abcdefgh"])
        words = sorted({word(letters) for _ in range(draw.randint(1, 60))})
        asked = sorted({word(letters) for _ in range(20)} | set(words[:5]))
        monkeypatch.setattr(spelling, "BLOCK_STATES", draw.choice([1, 5, 1 << 18]) if trial % 3 == 0 else 1 << 18)
        q, w = spelling.near_words(spelling.Trie([x.encode() for x in words]), spelling.Queries([x.encode() for x in asked]))
        assert set(zip(q.tolist(), w.tolist(), strict=True)) == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if plain_near(a, b)}


def test_long_words(spark):
    long = "ab" * 40_000
    words = spark.createDataFrame([(long, 50), (long[:-1], 5), ("x" + long, 6), ("z" * 90_000, 5)], "word string, n long")
    got = {len(r.word): (r.n_near, r.form_n) for r in spelling.spelling_variants(words).collect()}
    assert got == {80_000: (2, None), 79_999: (1, 50), 80_001: (1, 50), 90_000: (0, None)}


def test_held_words_are_emitted_in_parts(spark, documents, monkeypatch):
    whole = {tuple(r) for r in spelling.word_counts(documents).collect()}
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    assert {tuple(r) for r in spelling.word_counts(documents).collect()} == whole


def test_letters_that_are_kept_apart(spark):
    texts = [(1, "ÉCOLES écoles Écoles ÀÀÀÀÀÀ×÷ straße naïvetéŒuvre" * 5), (None, "planet planets " * 5), (None, None), (2, "")]
    got = dict(map(tuple, spelling.word_counts(spark.createDataFrame(texts, "doc_id long, text string")).collect()))
    assert got == plain_counts(texts)


def test_edges(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = spelling.spelling_variants(spelling.word_counts(odd))
    assert {tuple(r) for r in found.select(COLUMNS).collect()} == plain_variants(plain_counts(rows))
    assert spelling.spelling_variants(spelling.word_counts(empty)).count() == 0
    repeated = odd.union(odd)
    assert {(r.word, r.n) for r in spelling.word_counts(repeated.filter(F.col("doc_id").isNotNull())).collect()} == set(plain_counts([x for x in rows * 2 if x[0] is not None]).items())
