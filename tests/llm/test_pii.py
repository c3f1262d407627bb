from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np

from folioscan.llm import boosting, pii

LUHN_OK = "4539578763621486"


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, f in BASE for m in re.finditer(p, text or "") if f(m[0])]


TRICKY = [
    "a@b.c_d@e.f x@y@z.com a@b..c @x.y .@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 0.0.0.0 01.002.0003.255 1.2.3", f"{LUHN_OK} 4539-5787-6362-1486 4539  5787 {LUHN_OK}-1 x{LUHN_OK}",
    "+1 (555) 010-9999 +12 +123456789012345 +1234567890123456 ++49 30 123456, +4930-", "é😀 mail ü@x.de and ab@x-y.co.uk. +49 (0)30 1234567 8.8.8.8", "9" * 5000, "a" * 5000 + "@", "1 " * 3000, "+1" * 2000, "a." * 3000 + "@b.c",
]


def test_base_spans_are_the_patterns_matches(spark, documents):
    texts = TRICKY + [r.text for r in documents.select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(docs).collect():
        assert [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.base] == brute(texts[r.doc_id]), texts[r.doc_id][:80]
        for s in [*r.base, *r.added]:
            assert texts[r.doc_id][s.start : s.end] == s.value
        for s in r.added:
            assert not any(b.start < s.end and s.start < b.end for b in r.base)


def test_the_model_adds_what_the_patterns_miss_and_leaves_the_rest(spark):
    docs = spark.createDataFrame([
        (1, f"two cards {LUHN_OK} {LUHN_OK} here"), (2, "write mail to anna [at] example [dot] com today"), (3, "call (555) 123-4567 soon"),
        (4, "order 1234567812345678 of part 555-123-4567 in version 1.2.3"), (5, "we met at noon. Then left"), (6, "nothing of the kind in these words"),
    ], "doc_id long, text string")
    added = {r.doc_id: [s.value for s in r.added] for r in pii.find(docs).collect()}
    assert added[1] == [LUHN_OK, LUHN_OK] and added[2] == ["anna [at] example [dot] com"] and len(added[3]) == 1
    assert added[4] == added[5] == added[6] == []


def test_the_model_on_held_out_rows(spark):
    model, thresholds = pii.fitted(spark)
    assert len(thresholds) == 4 and all(0.5 <= t <= 1 for t in thresholds) and model.trees


def other_texts() -> list[tuple[str, str, str]]:
    """(kind, text, truth or ''): written apart from the training table, in other words, languages and shapes."""
    draw = np.random.default_rng(77)
    digits = lambda n: str(draw.integers(1, 10)) + "".join(map(str, draw.integers(0, 10, n - 1)))

    def card(n, first, right=True):
        body = first + digits(n - 1 - len(first))
        return next(body + c for c in "0123456789" if luhn(body + c) == right)

    fours = lambda d, sep: sep.join(d[k : k + 4] for k in range(0, len(d), 4))
    rows = []
    for k in range(25):
        user, site, end = ["j.miller", "karl_99", "ines+shop", "office", "t-brandt"][k % 5], ["quartz", "blue-sea", "mondo", "k7lab"][k % 4], ["com", "org", "net", "de", "fr"][k % 5]
        at, dot = [(" [at] ", " [dot] "), ("(at)", "(dot)"), (" {at} ", " {dot} "), ("[at]", "."), (" at ", " dot ")][k % 5]
        lead = ["Schreiben Sie an", "Please reach me under", "Mon adresse est", "Escriba a", "You may contact"][k % 5]
        rows += [("email", f"{lead} {user}{at}{site}{dot}{end} bis Freitag.", f"{user}{at}{site}{dot}{end}"), ("email", f"They stood at {site}. {end.title()} said nothing, at least. Later", "")]
        octets = [str(x) for x in draw.integers(1, 255, 4)]
        shown = ["[.]".join(octets), "(.)".join(octets), " . ".join(octets)][k % 3] if k % 3 < 2 else "[.]".join(octets)
        rows += [("ip", f"{['The server', 'Unser Host', 'Login from', 'client'][k % 4]} {shown} wrote to us", shown), ("ip", f"see chapter {k % 9 + 1} . {k % 7} . {k % 5} . {k % 3} of the book", "")]
        c = [card(16, "4"), card(16, "51"), card(15, "37"), card(16, "52")][k % 4]
        shape = [c, fours(c, "."), f"{c[:4]} {c[4:10]} {c[10:]}" if len(c) == 15 else fours(c, "/"), fours(c, ".")][k % 4]
        rows += [("card", f"{['I paid with my card', 'Visa', 'Kreditkarte', 'charge the card'][k % 4]} {shape}, thanks", shape), ("card", f"{['invoice', 'tracking', 'batch', 'serial'][k % 4]} {card(16, '7', False)} arrived", ""), ("card", f"measured {fours(card(16, '8', False), '.')} units", "")]
        a, b, d = digits(3), digits(3), digits(4)
        phone = [f"({a}) {b}-{d}", f"{a}-{b}-{d}", f"{a}.{b}.{d}", f"0049 {a} {b}{d}"][k % 4]
        rows += [("phone", f"{['Ring me on', 'my phone is', 'Rufen Sie an, tel', 'fax or call'][k % 4]} {phone} tonight", phone), ("phone", f"{['order', 'part', 'section', 'model'][k % 4]} {a}-{b}-{d} is sold", ""), ("phone", f"from 19{digits(2)}-0{1 + k % 9}-1{k % 9} until 2001", "")]
    return rows


def test_precision_and_recall_on_texts_of_another_making(spark):
    rows = other_texts()
    docs = spark.createDataFrame([(k, text) for k, (_, text, _) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: {(pii.KINDS[s.kind], s.value) for s in [*r.base, *r.added]} for r in pii.find(docs).collect()}
    right, wrong, missed = Counter(), Counter(), Counter()
    for k, (kind, _, truth) in enumerate(rows):
        for name, value in found[k]:
            (right if (name, value) == (kind, truth) else wrong)[name] += 1
        missed[kind] += bool(truth) and (kind, truth) not in found[k]
    figures = {k: (round(right[k] / max(right[k] + wrong[k], 1), 2), round(right[k] / (right[k] + missed[k]), 2)) for k in pii.KINDS}
    print(figures)
    assert all(precision >= 0.9 and recall >= 0.7 for precision, recall in figures.values()), figures


def test_many_matches_in_one_text(spark):
    """Places, overlaps and redaction beyond the sizes that are compared pair by pair."""
    parts = [["call (555) 123-4567", "1.2.3.4", "a@b.example.com", f"visa {LUHN_OK}", "order 12345", "+1 555 010 9999", "mail x [at] y [dot] com"][k % 7] for k in range(1500)]
    text = "é😀 " + ", ".join(parts)
    docs = spark.createDataFrame([(1, text, 0), (2, "7 " * 30_000, 0)], "doc_id long, text string, n_chars int")
    r = next(r for r in pii.find(docs).collect() if r.doc_id == 1)
    assert [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.base] == brute(text)
    spans = sorted([(s.start, s.end) for s in [*r.base, *r.added]])
    assert all(text[s.start : s.end] == s.value for s in r.added) and len(r.added) > 200
    taken = [(s.start, s.end) for s in r.added]
    assert all(b <= c for (_, b), (c, _) in zip(taken, taken[1:], strict=False))
    assert not any(s < e2 and s2 < e for s, e in taken for s2, e2 in [(x.start, x.end) for x in r.base])
    # one by one, as a short text of the same parts has them
    short = pii.find(spark.createDataFrame([(1, "é😀 " + ", ".join(parts[:14]))], "doc_id long, text string")).first()
    assert [(s.start, s.value) for s in short.added] == [(s.start, s.value) for s in r.added][: len(short.added)]
    clean, at, names = [], 0, {s.start: pii.KINDS[s.kind].upper() for s in [*r.added, *reversed(r.base)]}
    for s, e in spans:
        if s >= at:
            clean += [text[at:s], f"[{names[s]}]"]
        at = max(at, e)
    redacted = next(r for r in pii.redact(docs).collect() if r.doc_id == 1)
    assert redacted.text == "".join(clean) + text[at:] and redacted.n_chars == len(redacted.text)


def test_running_totals(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    arrays = [[], [5], rng.integers(0, 9, 64).tolist(), rng.integers(0, 9, 65).tolist(), rng.integers(0, 9, 9999).tolist()]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(arrays)], "k int, a array<int>")
    for r in df.select("k", pii.running(F.col("a")).alias("s"), pii.running(F.col("a"), F.greatest).alias("m")).collect():
        assert r.s == np.cumsum(arrays[r.k]).tolist() and r.m == np.maximum.accumulate(np.array(arrays[r.k], int)).tolist()


def test_redaction_keeps_columns_and_lengths(odd, empty, spark):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    row = out.filter("text LIKE 'Mail %'").first()
    assert row.text == "Mail [EMAIL] or [PHONE] now." and row.n_chars == len(row.text)
    assert pii.redact(empty).count() == 0
    overlap = spark.createDataFrame([(1, "x +1 10.20.30.40 y", 18)], "doc_id long, text string, n_chars int")
    text = pii.redact(overlap).first().text
    assert "10.20" not in text and text.startswith("x [") and text.endswith(" y")


def test_query_digest(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    from folioscan.llm.queries import QUERIES

    for r in QUERIES["op3_personal_data"](documents.sparkSession, "/root/testdata/sf0.001").collect():
        assert r.base_sha256 == hashlib.sha256(",".join(brute(texts[r.doc_id])).encode()).hexdigest()


def test_trees_as_columns_equal_trees(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (200, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(float)
    model = boosting.calibrate(boosting.boost(x, y), x, y)
    p = model.probability(x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.97
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = np.array([r.p for r in rows.select(model.column(lambda k: F.col("abc"[k])).alias("p")).collect()])
    assert np.allclose(got, p)


def test_every_candidate_has_a_hint(spark):
    from pyspark.sql import functions as F

    pairs = [(a, d) for a in ("@", " @ ", "[at]", " [AT] ", "(at)", " (at) ", "{at}", " {at} ", " at ", "  at  ", " At ") for d in (".", " . ", "[dot]", " [dot] ", "(dot)", " (DOT) ", "{dot}", " {dot} ", " dot ", " Dot ")]
    texts = [f"write to anna{a}example{d}com today" for a, d in pairs]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select("text", F.size(pii.candidates(F.col("text"))).alias("n"), F.col("text").rlike(pii._HINT).alias("hint")).collect()
    assert all(r.hint for r in rows if r.n) and sum(r.n > 0 for r in rows) == len(rows)
    plain = [(1, "write mail to anna at example.com today"), (2, "write mail to anna at example [dot] com today")]
    for r in pii.find(spark.createDataFrame([*plain, *((k + 10, t + " 7") for k, t in plain)], "doc_id long, text string")).collect():
        other = plain[(r.doc_id % 10) - 1][1]
        scored = pii.with_spans(spark.createDataFrame([(other,)], "text string"), F.col("text"), hinted=False).first().added
        assert [s.value for s in r.added] == [s.value for s in scored]
