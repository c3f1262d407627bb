from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pytest

from folioscan.llm import mixing


def brute_targets(sizes: dict, weights=mixing.WEIGHTS, share=mixing.SHARE, most=mixing.MOST) -> dict:
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, target, left = share * sum(sizes.values()), {}, set(order)
    while left:
        level = (total - sum(target.values())) / sum(w[s] for s in left)
        full = [s for s in left if level * w[s] >= most * sizes[s]]
        if not full:
            return target | {s: level * w[s] for s in left}
        for s in full:
            target[s] = most * sizes[s]
            left.discard(s)
    return target


def test_targets_and_taken_words(documents):
    rows = mixing.taken_words(documents).collect()
    texts = {r.doc_id: r for r in documents.collect()}
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id].text or "")) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    want = brute_targets(sizes)
    for s in sizes:
        # ten documents a source here: a source ends within half of its largest one
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= largest[s] / 2


def test_rates_are_tilted_exponentially(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 50), f"s{k % 3}") for k in range(3000)], "doc_id long, text string, source string")
    rows = mixing.taken_words(docs).collect()
    for s in ("s0", "s1", "s2"):
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.001 * own[0].target + 1


def test_mix_repeats_rows_and_keeps_columns(odd, empty):
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.filter("text IS NULL OR trim(text) = ''").count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.taken_words(empty).count() == 0
    rows = mixing.taken_words(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r.size for r in rows)


def test_a_null_source_is_a_source_of_its_own(spark):
    docs = spark.createDataFrame([(k, "a b c d", None if k % 2 else "z") for k in range(200)], "doc_id long, text string, source string")
    target = {r.source: r.target for r in mixing.taken_words(docs).collect()}
    assert target == pytest.approx(brute_targets({"z": 400, None: 400}))


def test_a_few_huge_documents_with_most_words(spark):
    """lambda settles, and words meet the target, whatever the sizes and the target."""
    sizes = [(3, 1000), (40, 800), (700, 150), (2_000_000, 8)]
    rows = [(f"s{share}", size, n) for share in (3, 9, 15, 17, 20) for size, n in sizes]
    counts = spark.createDataFrame(rows, "source string, size long, n long")
    whole = sum(size * n for size, n in sizes)
    targets = counts.select("source").distinct().selectExpr("source", f"{whole}L AS source_size", f"CAST(substr(source, 2) AS double) / 10 * {whole} AS target")
    for r in mixing.solve(counts, targets).collect():
        got = sum(size * n * min(2.0, math.exp(min(50.0, r.lam * size / r.mean))) for size, n in sizes)
        assert abs(got - r.target) <= 2e-6 * r.target

    docs = spark.createDataFrame([(k, "a", z) for k, z in enumerate(z for z, n in sizes for _ in range(n))], "doc_id long, source string, size long")
    for share in (0.3, 1.5, 1.7):
        own = mixing.balance(docs, weights=(1,), share=share).collect()
        assert own[0].target == pytest.approx(share * whole) and abs(sum(x.copies * x.size for x in own) - own[0].target) <= 1_000_000


def test_a_source_of_empty_texts_takes_nothing(spark):
    docs = spark.createDataFrame([(k, s, k * k if s == "b" else 0) for s in ("a", "b") for k in range(100)], "doc_id long, source string, size long")
    rows = mixing.balance(docs).collect()
    assert all(r.copies == 0 and r.target == 0 for r in rows if r.source == "a") and sum(r.copies for r in rows) > 0


def brute_lambda(sizes: np.ndarray, target: float, most: float = mixing.MOST) -> float:
    """lambda by plain bisection; rates grow with it."""
    low, high, mean = -1e4, 1e4, sizes.mean()
    for _ in range(300):
        at = (low + high) / 2
        got = (sizes * np.minimum(most, np.exp(np.minimum(50, at * sizes / mean)))).sum()
        low, high = (at, high) if got < target else (low, at)
    return (low + high) / 2


def test_rates_equal_those_of_a_plain_solver(spark):
    draw = np.random.default_rng(5)
    every = {"uniform": draw.integers(1, 1000, 3000), "lognormal": np.exp(draw.normal(5, 1.5, 3000)).astype(int) + 1, "pareto": (draw.pareto(0.8, 3000) * 10).astype(int) + 1, "two-valued": np.array([1] * 4900 + [20_000] * 100)}
    aims = {f"{kind} {share}": (sizes.astype(float), share) for kind, sizes in every.items() for share in (0.4, 1.0, 1.5, 1.9)}
    rows = [(s, int(z), int(n)) for s, (sizes, _) in aims.items() for z, n in zip(*np.unique(sizes, return_counts=True), strict=True)]
    targets = [(s, int(sizes.sum()), share * float(sizes.sum())) for s, (sizes, share) in aims.items()]
    solved = mixing.solve(spark.createDataFrame(rows, "source string, size long, n long"), spark.createDataFrame(targets, "source string, source_size long, target double")).collect()
    assert len(solved) == len(aims)
    for r in solved:
        sizes, _ = aims[r.source]
        want = brute_lambda(sizes, r.target)
        rates = lambda lam: np.minimum(mixing.MOST, np.exp(np.minimum(50, lam * sizes / sizes.mean())))
        # an expected word in a million may lie elsewhere
        assert abs((rates(r.lam) * sizes).sum() - r.target) <= 2e-6 * r.target and np.abs((rates(r.lam) - rates(want)) * sizes).sum() <= 1e-5 * sizes.sum()


def test_few_huge_documents_meet_their_target(spark):
    small = [(k, "a", 1) for k in range(4900)] + [(4900 + k, "a", 20_000) for k in range(100)]
    for rows in (small, small + [(10_000 + k, "b", 4000) for k in range(1000)]):
        out = mixing.balance(spark.createDataFrame(rows, "doc_id long, source string, size long")).filter("source = 'a'").collect()
        assert abs(sum(r.copies * r.size for r in out) - out[0].target) <= 10_000 and max(r.copies for r in out) <= 2


def test_partitions_and_ties_change_nothing(spark):
    """Documents of equal sizes tie for the flip at the end."""
    docs = spark.createDataFrame([(k, f"s{k % 4}", 10 + k % 3 * 7) for k in range(3000)], "doc_id long, source string, size long")
    results = [sorted((r.doc_id, r.copies) for r in mixing.balance(docs.repartition(n, "doc_id")).collect()) for n in (1, 29)]
    assert results[0] == results[1]


def test_a_million_sources(spark):
    """Targets of very many sources: running sums, not a frame that is summed anew for each row."""
    import time

    began = time.perf_counter()
    sizes = spark.range(1_000_000).selectExpr("concat('s', id) AS source", "1 + id % 997 AS size", "1L AS n")
    r = mixing.source_targets(sizes).selectExpr("count(*) AS n", "sum(target) AS t", "sum(source_size) AS s", "max(target / source_size) AS most").first()
    assert r.n == 1_000_000 and abs(r.t - 1.5 * r.s) < 1e-6 * r.s and r.most <= 2 + 1e-9
    assert time.perf_counter() - began < 60
