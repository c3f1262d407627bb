from __future__ import annotations

import hashlib
import math

from pyspark.sql import functions as F

from folioscan.llm import fingerprints as fp


def test_equal_texts_have_equal_digests_and_differences_are_bounded():
    texts = ["", "ab", "abc", "the quick brown fox " * 40, "the quick brown fox " * 39 + "jumps", "völlig andere Wörter " * 50]
    digests = [fp.digest(t) for t in texts]
    assert all(len(d) == 132 for d in digests) and fp.digest(texts[3]) == digests[3]
    for a in digests:
        assert fp.difference(a, a) == 0 and fp.likeness(a, a) == 1
        for b in digests:
            assert 0 <= fp.difference(a, b) == fp.difference(b, a) <= fp.MAX_DIFFERENCE
    assert fp.likeness(digests[3], digests[4]) > fp.likeness(digests[3], digests[5])


def plain_digest(text):
    """Bucket counts, quartiles, length and ratios, by loops."""
    data = text.encode()
    counts = [0] * 256
    for k in range(len(data) - 2):
        counts[((data[k] | data[k + 1] << 8 | data[k + 2] << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 24] += 1
    q1, q2, q3 = (sorted(counts)[64 * k - 1] for k in (1, 2, 3))
    bits = "".join(format((c > q1) + (c > q2) + (c > q3), "02b") for c in counts)
    ratios = (16 * q1 // (q3 + 1), 16 * q2 // (q3 + 1)) if q3 else (0, 0)
    return f"{min(255, round(12 * math.log1p(len(data)))):02x}{ratios[0]:x}{ratios[1]:x}" + "".join(f"{int(bits[k : k + 8], 2):02x}" for k in range(0, 512, 8))


def plain_likeness(a, b):
    quartiles = lambda d: [int(c, 16) >> s & 3 for c in d[4:] for s in (2, 0)]
    body = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(quartiles(a), quartiles(b), strict=True))
    length = min(24, max(0, abs(int(a[:2], 16) - int(b[:2], 16)) - 1))
    ratios = min(16, abs(int(a[2], 16) - int(b[2], 16)) + abs(int(a[3], 16) - int(b[3], 16)))
    return 1 - min(512, body + length + ratios) / 512


def brute(rows):
    """(doc_id, text) by descending doc_id, nulls last -> edited sha and likenesses by definition."""
    return following(sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0))))


def following(ordered):
    out = {}
    for k, (doc_id, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1] or ""
        text = text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed = plain_digest(text), plain_digest(edited)
        out.setdefault(doc_id, []).append((len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, plain_likeness(own, changed), plain_likeness(own, plain_digest(after))))
    return out


def test_edits_match_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    found = {r[0]: [tuple(r[1:])] for r in fp.compare_with_edits(documents).collect()}
    assert found == brute(rows)


def test_edges(odd, empty):
    one = odd.filter("doc_id = 4")
    assert [tuple(r)[:2] for r in fp.compare_with_edits(one).collect()] == [(4, 1)]  # it is followed by itself
    assert fp.compare_with_edits(odd).count() == odd.count()
    assert fp.compare_with_edits(empty).count() == 0
    both = {r.fingerprint for r in fp.fingerprint_documents(odd.filter("text LIKE 'same text%'")).collect()}
    assert len(both) == 1


def test_ids_that_repeat_and_nulls_by_value(spark):
    """Half of the rows have one id, a fifth none: both are cut into several slots."""
    rows = [(7 if k % 2 else None if k % 5 == 0 else k - 200, f"text {k} " * (k % 9)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ties = {r.text: r.t for r in docs.select("text", F.xxhash64("text").alias("t")).collect()}
    want = following(sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -ties[r[1]])))
    found = {}
    for r in fp.compare_with_edits(docs).collect():
        found.setdefault(r[0], []).append(tuple(r[1:]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    held = {r.slot: r["count"] for r in fp.with_following(docs, 16).groupBy("slot").count().collect()}
    assert len(held) > 10 and max(held.values()) < 100
