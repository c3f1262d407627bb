from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np

from folioscan.llm import periodic
from folioscan.llm.queries import QUERIES

SMOKE = "/root/testdata/sf0.001"


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """Each period's maximal stretches, word by word; of equal stretches the least period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    exponent = 1000 * best[1] // best[2] if runs else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, exponent, digest(lines), digest(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def rows_of(df):
    return [tuple(r)[:8] for r in df.collect()]


def test_whole_table_against_plain_runs(spark):
    texts = spark.read.parquet(f"{SMOKE}/documents.parquet").collect()
    got = rows_of(QUERIES["op12_periodic_runs"](spark, SMOKE))
    assert sorted(got) == sorted(expected(r.doc_id, r.text) for r in texts)
    assert sum(r[1] > 0 for r in got) > 5


def test_runs_of_few_letters_against_plain_runs():
    draw = random.Random(4)
    for _ in range(1500):
        n = draw.randint(0, 70)
        words = [draw.randrange(draw.choice([1, 2, 2, 3])) for _ in range(n)]
        if n and draw.random() < 0.5:
            a = draw.randrange(n)
            p = 1 + (n - a) // draw.randint(3, 10)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        assert [tuple(r) for r in periodic.runs_of(np.array(words, np.int32)).tolist()] == plain_runs(words)


def test_small_blocks_of_candidates_change_nothing(monkeypatch):
    words = np.array([k % 7 for k in range(400)] + [k % 3 for k in range(200)], np.int32)
    whole = periodic.runs_of(words).tolist()
    monkeypatch.setattr(periodic, "BLOCK", 3)
    assert periodic.runs_of(words).tolist() == whole == [list(r) for r in plain_runs(words.tolist())]


def test_agreements_are_read_off_levels():
    draw = random.Random(5)
    words = np.array([draw.randrange(2) for _ in range(300)], np.int32)
    levels = periodic.name_levels(words)
    pairs = [(i, j) for i in range(0, 299, 3) for j in range(i + 1, 300, 7)]
    i, j = (np.array(x) for x in zip(*pairs, strict=True))
    for (a, b), f, r in zip(pairs, periodic.agree_forwards(levels, i, j), periodic.agree_backwards(levels, i, j), strict=True):
        assert f == next(t for t in range(301) if b + t >= 300 or words[a + t] != words[b + t])
        assert r == next(t for t in range(301) if a - t - 1 < 0 or words[a - t - 1] != words[b - t - 1])


def test_long_texts_of_one_word_and_of_a_long_period():
    n = 300_000
    assert periodic.runs_of(np.zeros(n, np.int32)).tolist() == [[0, n, 1]]
    words = np.random.default_rng(0).integers(0, 1000, 20_000)
    assert periodic.runs_of(np.tile(words, 4).astype(np.int32)).tolist() == [[0, 80_000, 20_000]]
    assert periodic.runs_of(np.tile(words, 4)[:-1].astype(np.int32)).tolist() == []


def test_edges(spark, odd, empty):
    got = periodic.periodic_runs(odd, edit=periodic.repeated_tail, texts=True).collect()
    assert len(got) == odd.count()
    by_text = {(r.doc_id, r.text): r.text for r in odd.collect()}
    for r in got:
        assert r.n_words == len((next(t for (k, t), _ in by_text.items() if k == r.doc_id) or "").encode().split()) or r.doc_id is None
    plain = {(r.doc_id, tuple(map(tuple, r.runs)), r.collapsed_sha256) for r in got}
    for r in odd.collect():
        doc_id, _, _, _, _, _, lines, collapsed = expected(r.doc_id, r.text) if r.text is None or len(r.text) < 1000 else (None,) * 8
        if lines:
            assert any(d == doc_id and c == collapsed for d, _, c in plain)
    assert any(r.collapsed == "word" for r in got)
    assert periodic.periodic_runs(empty).count() == 0
