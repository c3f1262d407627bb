from __future__ import annotations

import itertools
import re
import time
from collections import Counter, defaultdict

import numpy as np
import xxhash

from folioscan.llm import simhash as sh
from folioscan.llm.components import connected_components


def brute_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: list[int], radius=4) -> list[int]:
    x = np.array(fps, np.uint64)
    label = np.arange(len(x))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label.tolist()
        label = new


def test_fingerprints(documents, odd):
    rows = documents.select("doc_id", "text").collect() + odd.select("doc_id", "text").collect()
    for r in rows:
        if len(r.text or "") < 20_000:
            assert sh.simhash(r.text) == brute_fingerprint(r.text)


def test_components_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in sh.near_duplicates(docs).collect())
    label = brute_components([g[1] for g in got])
    assert [g[2] for g in got] == [got[k][0] for k in label]


def near_points(seed=1, groups=60, size=12, alone=3000):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, groups, dtype=np.uint64)
    flips = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for c in centres for _ in range(size)]
    return np.unique(np.array([*flips, *rng.integers(0, 2**63, alone, dtype=np.uint64), 0, 2**64 - 1], np.uint64))


def test_shards_lose_no_link(spark):
    points = near_points()
    frame = spark.createDataFrame([(int(p), int(p), b"", 0) for p in points.view(np.int64)], "key long, fp long, more binary, shingles int")
    want = brute_components(points.tolist())
    for shard, cell in ((100, 10**6), (700, 150), (10**6, 300)):
        edges = sh.link_fingerprints(frame, shard=shard, cell=cell)
        assert edges.count() <= 9 * len(points)
        roots = {r.node: r.root for r in connected_components(edges).collect()}
        groups: dict[int, set] = {}
        for k, p in enumerate(points.view(np.int64).tolist()):
            groups.setdefault(want[k], set()).add(p)
        for g in groups.values():
            assert len({roots.get(p, p) for p in g}) == 1
            assert min(g) == roots.get(min(g), min(g)) and len(g) > 1 or not any(p in roots for p in g)


def test_tree_deals_each_point_once_and_covers_the_radius():
    points = near_points(2)
    tree = sh.VantageTree(points[::3], 40)
    index, shard, own = tree.deal(points, 4)
    member = shard == own
    assert tree.shards > 10 and sorted(index[member].tolist()) == list(range(len(points)))
    home = dict(zip(index[member].tolist(), shard[member].tolist(), strict=True))
    at = {}
    for i, s in zip(index.tolist(), shard.tolist(), strict=True):
        at.setdefault(i, set()).add(s)
    d = np.bitwise_count(points[:, None] ^ points[None, :])
    for a, b in zip(*np.nonzero(d <= 4), strict=True):
        assert home[int(b)] in at[int(a)] or home[int(a)] in at[int(b)]


def test_star_contraction(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 4000), (4000, 4500), (1, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[1000 + k] == 1000 for k in range(300)) and {got[4000], got[4500], got[5000]} == {4000}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_similar_texts_go_and_others_stay(spark):
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(4000)]
    base = [list(rng.choice(words, 400)) for _ in range(40)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)]
    for k, b in enumerate(base[:20]):
        changed = list(b)
        for j in rng.choice(400, 4, replace=False):  # about nine tenths of the shingles stay
            changed[j] = "changed"
        rows += [(100 + k, " ".join(changed)), (200 + k, " ".join(b).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in sh.keep_one(docs, words=5, similarity=0.8).collect()}
    assert kept == set(range(40))


def test_edges(odd, empty):
    got = sh.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].fp == by[1].fp == by[2].fp == 0 and by[0].component_id == by[2].component_id == 0
    assert by[11].component_id == 10  # equal texts; row 11 is there twice
    kept = sh.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(10) == 1 and 11 not in ids and ids.count(None) == 1  # the null text is a copy of the empty one
    assert sh.near_duplicates(empty).count() == 0 and sh.keep_one(empty).count() == 0


def brute_kept(texts: dict[int, str], similarity=0.8) -> set[int]:
    sets = {k: set(zip(*(t.lower().split()[j:] for j in range(5)), strict=False)) for k, t in texts.items()}
    root = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if r == old else r for k, r in root.items()}
    return {k for k in root if root[k] == k}


def test_repeated_lines_and_near_pairs_match_brute_force(spark):
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    line = fresh(12)
    texts = [fresh(200) + line * 15, fresh(200) + line * 15, fresh(200) + ["na"] * 300, fresh(200) + ["na"] * 300]
    body = fresh(400)
    texts += [body + line * n for n in (2, 12)]
    for changes in range(2, 20):  # similarities about and under 0.9, over and under 0.8
        b = fresh(400)
        c = list(b)
        for j in rng.choice(400, changes, replace=False):
            c[j] = "other"
        texts += [b, c]
    rows = {k: " ".join(t) for k, t in enumerate(texts)}
    kept = {r.doc_id for r in sh.keep_one(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), words=5, similarity=0.8).collect()}
    assert kept == brute_kept(rows) and {0, 1, 2, 3} <= kept and 5 not in kept


def brute_links(texts: dict[int, str], similarity=0.8) -> list[tuple[int, int]]:
    """All pairs whose sets of five-word shingles reach the similarity, by an inverted index."""
    sets = {k: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x20\x09-\x0D]+", t.lower())) else set() for k, t in texts.items()}
    holders = defaultdict(list)
    for k, own in sets.items():
        for x in own:
            holders[x].append(k)
    common = Counter((a, b) for held in holders.values() for a, b in itertools.combinations(sorted(held), 2))
    return [(a, b) for (a, b), n in common.items() if n >= similarity * (len(sets[a]) + len(sets[b]) - n)]


def test_recall_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 60000")
    texts = {r.doc_id: r.text.translate(ASCII_LOWER) for r in docs.collect()}
    root = {r.doc_id: r.root for r in sh.grouped(docs, words=5, similarity=0.8).collect()}
    links = brute_links(texts)
    together = sum(root[a] == root[b] for a, b in links)
    assert len(links) > 100 and together >= 0.99 * len(links)
    # nothing else is together
    apart = {k: k for k in texts}
    for a, b in links:
        old, new = max(apart[a], apart[b]), min(apart[a], apart[b])
        apart = {k: new if r == old else r for k, r in apart.items()}
    first = {}
    for k in sorted(root):
        assert apart[first.setdefault(root[k], k)] == apart[k]


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def test_candidates_that_fail_are_searched_again(spark, monkeypatch):
    """Variants of a few texts, most of them less alike than is asked for, in cells of a few rows."""
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(4):
        body = [f"v{x}" for x in rng.integers(0, 10**9, 400)]
        for _ in range(40):
            b = list(body)
            for j in rng.choice(400, int(rng.integers(2, 24)), replace=False):
                b[j] = f"x{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    searches = []
    link = sh.link_candidates
    monkeypatch.setattr(sh, "link_candidates", lambda active, similarity, each: searches.append(each) or link(active, similarity, each, cell=32))
    monkeypatch.setattr(sh, "PAIRS_A_TASK", 3)
    monkeypatch.setattr(sh, "PAIRS", 2)
    monkeypatch.setattr(sh, "TOGETHER", 3000)
    root = {r.doc_id: r.root for r in sh.grouped(docs, words=5, similarity=0.8).collect()}
    label = {k: k for k, _ in rows}
    for a, b in brute_links(dict(rows)):
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {k: new if r == old else r for k, r in label.items()}
    least = {}
    for k, _ in rows:
        least.setdefault(root[k], k)
    assert {k: least[root[k]] for k, _ in rows} == label and len(searches) > 2 and len(set(label.values())) > 5


def lanes_of(sets):
    """Fingerprints of sets of hashes: first lanes, and further ones as rows."""
    raw = [np.frombuffer(sh.simhash_lanes(sh._mixed(np.asarray(x, np.uint64), 31), sh.LANES), np.uint64) for x in sets]
    table = np.array(raw).reshape(len(sets), sh.LANES)
    return table[:, 0].copy(), table[:, 1:].copy()


def test_jaccard_components_follow_chains():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 10, 20, 30, 500, 900, 905)] + [np.zeros(0, np.uint64)]
    near = np.zeros(len(sets), np.uint64), np.zeros((len(sets), sh.LANES - 1), np.uint64)
    assert sh.jaccard_components(sets, *near, 0.8).tolist() == [0, 0, 0, 0, 4, 5, 5, 7]
    far = np.array([0, 2**63 + 2**40 - 1, 0, 0, 0, 0, 0, 0], np.uint64), near[1]
    assert sh.jaccard_components(sets, *far, 0.8).tolist() == [0, 1, 2, 2, 4, 5, 5, 7]  # alike, but not within the bits
    assert sh.jaccard_components(sets, *near, 0.8, most_work=100) is None


def test_jaccard_components_against_all_pairs():
    """Families of sets about the similarity, with elements that all share and ones that few do."""
    draw = np.random.default_rng(5)
    for trial in range(60):
        universe = int(draw.choice([30, 130, 2000]))
        base = [draw.choice(universe, min(universe, 25), replace=False) for _ in range(3)]
        sets = [np.unique(np.concatenate([base[k % 3], draw.integers(0, universe * 2, int(draw.integers(0, 9)))])) for k in range(40)]
        n, label = len(sets), list(range(40))
        for i, j in itertools.combinations(range(n), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both * 1.8 >= 0.8 * (len(sets[i]) + len(sets[j])) - 1e-9:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
        zeros = np.zeros(n, np.uint64), np.zeros((n, sh.LANES - 1), np.uint64)
        assert sh.jaccard_components(sets, *zeros, 0.8).tolist() == label


def test_many_unlike_sets_of_one_component():
    """80,000 sets of 100: a fifth their own, the rest shared by all of a family, so that each pair is a candidate and none is alike."""
    families, each, shared = 80, 1000, 78
    sets = [np.concatenate([np.arange(shared) + 10_000 * f, 10_000_000 + (f * each + k) * 22 + np.arange(22)]) for f in range(families) for k in range(each)]
    near = np.zeros(len(sets), np.uint64), np.zeros((len(sets), sh.LANES - 1), np.uint64)
    began = time.perf_counter()
    assert np.array_equal(sh.jaccard_components(sets, *near, 0.8), np.arange(len(sets)))
    assert time.perf_counter() - began < 60


def test_many_copies_in_one_component():
    base = np.arange(1000)
    sets = [np.concatenate([base, [10_000 + k]]) for k in range(8000)]
    near = np.zeros(len(sets), np.uint64), np.zeros((len(sets), sh.LANES - 1), np.uint64)
    began = time.perf_counter()
    assert not sh.jaccard_components(sets, *near, 0.8).any()
    assert time.perf_counter() - began < 60


def test_one_rule_whatever_the_size_of_a_component(spark, monkeypatch):
    """Two sets alike but not within the bits, a third near both but unlike: no link, whether judged together or pair by pair."""
    draw = np.random.default_rng(8)
    found = None
    body = [f"v{x}" for x in draw.integers(0, 10**9, 60)]
    sets_of = lambda w: np.unique(sh.shingle_hashes(" ".join(w), 5))
    lanes = lambda h: np.frombuffer(sh.simhash_lanes(h, sh.LANES), np.uint64)
    bits = lambda x, y: (int(np.bitwise_count(x[0] ^ y[0])), int(np.bitwise_count(x ^ y).sum()))
    alike = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    most = sh.bits_for(0.8, 64), sh.bits_for(0.8, 64 * sh.LANES)
    within = lambda x, y: bits(x, y)[0] <= most[0] and bits(x, y)[1] <= most[1]
    for _ in range(4000):
        a, b = list(body), list(body)
        a[int(draw.integers(0, 60))] = "x"
        b[-1 - int(draw.integers(0, 3))] = "y"
        ha, hb = sets_of(a), sets_of(b)
        if alike(ha, hb) >= 0.8 and not within(lanes(ha), lanes(hb)):
            for _ in range(300):
                c = list(a)
                for j in draw.choice(60, 2, replace=False):
                    c[j] = f"z{draw.integers(0, 10**6)}"
                hc = sets_of(c)
                if max(alike(ha, hc), alike(hb, hc)) < 0.8 and within(lanes(ha), lanes(hc)) and within(lanes(hb), lanes(hc)):
                    found = [" ".join(x) for x in (a, b, c)]
                    break
        if found:
            break
        body = [f"v{x}" for x in draw.integers(0, 10**9, 60)]
    assert found
    docs = spark.createDataFrame([*enumerate(found), (3, found[0] + " end")], "doc_id long, text string")
    results = []
    for together, work in ((sh.TOGETHER, sh.MOST_WORK), (0, sh.MOST_WORK), (sh.TOGETHER, 0)):
        monkeypatch.setattr(sh, "TOGETHER", together)
        monkeypatch.setattr(sh, "MOST_WORK", work)
        results.append({r.doc_id: r.component_id for r in sh.grouped(docs, words=5, similarity=0.8).collect()})
    assert results[0] == results[1] == results[2] == {0: 0, 1: 1, 2: 2, 3: 0}


def test_rows_that_repeat_id_and_text_keep_the_same_one(spark):
    docs = spark.createDataFrame([(1, "one two three four", x) for x in "cab"] + [(2, "other words here now", "z")], "doc_id long, text string, extra string")
    for n in (1, 3):
        assert sorted((r.doc_id, r.extra) for r in sh.keep_one(docs.repartition(n)).collect()) == [(1, "a"), (2, "z")]


def test_visits_of_the_tree_grow_as_the_readme_says():
    """Shards that a random fingerprint visits at radius 4, with the sample and shards of production."""
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**64, sh.SAMPLE, dtype=np.uint64)
    points = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    visits = {n: len(sh.VantageTree(sample, sh.SHARD * sh.SAMPLE / n).deal(points, 4)[0]) / len(points) for n in (10**6, 10**7)}
    assert visits[10**6] < 40 and visits[10**7] < 220
