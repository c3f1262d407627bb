"""Near-duplicates by SimHash and vantage-point trees.

1. A fingerprint has a bit set where over half of the text's shingle hashes do.
2. Distinct fingerprints are dealt to shards by a vantage-point tree, built on a
   bounded sample: each node splits by Hamming distance to its vantage point.
   A fingerprint is a member of one shard; by the triangle bound it also visits
   each later shard that may hold fingerprints within the radius.
   A shard with more rows than a task is meant to hold is cut into cells: blocks of
   its members, and of its visitors, that meet two by two in tasks of their own.
3. Within a cell a second, finer tree prunes blocks of fingerprints, and exact
   distances decide. A cell reports a spanning forest of its links, not its
   pairs, so a group of n near copies gives n - 1 edges a cell at most.
4. Components of all edges are found by distributed star contraction.
5. Where a similarity is asked for, not a radius, fingerprints are of the distinct
   shingles and have LANES lanes. Two documents are linked if and only if their fingerprints
   are within the bits that the similarity needs and the exact Jaccard similarity of their
   shingles reaches it, whatever else there is. The forests are of such candidate pairs, to be confirmed:
   a component of candidates of up to TOGETHER shingles in one task, over an inverted index of
   each set's rarest shingles. Larger ones, and those that turn out to need more than MOST_WORK,
   pair by pair: where a pair fails, the component is searched again, for pairs that aren't linked
   or refused yet, until there are none. Both ways judge by the same rule, so they agree.
   Equal sets of shingles are known by a 64-bit hash: at 10**9 different sets some three in a hundred
   runs take two of them for equal.

Null text is empty; a text with no word has fingerprint zero and links like any
other. Rows with null ids take part; a component's id is its least non-null id
(null if it has none). Repeated rows stay, with equal results. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, shuffle_partitions, table
from .components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Lanes of 64 bits where a similarity, not a radius, is asked for.
LANES = 8
#: Fingerprints that the sharding tree is built on, at most about.
SAMPLE = 40_000
#: Members a shard is meant to have.
SHARD = 16_000
#: Rows of a block of a shard that is cut; shards of up to two blocks aren't.
CELL = 100_000
#: Shingles of the candidates of one component, at most, that a task confirms together (64 MB of hashes), and the
#: shingles and index entries it may compare for that; what needs more is confirmed pair by pair, by the same rule.
TOGETHER = 8_000_000
MOST_WORK = 4_000_000_000
#: Shards that are cut and candidates, at most, that are broadcast (some 15 MB); more are joined by a shuffle.
BROADCAST_SHARDS = 500_000
BROADCAST_SUSPECTS = 200_000
#: Pairs with one document that a task gets; candidate pairs of a document in the second search, and how these grow.
PAIRS_A_TASK = 1000
#: Tasks of a search, at most, beyond the number of shuffle partitions.
MOST_TASKS = 20_000
PAIRS, PAIRS_GROWTH = 16, 16
MOST_SEARCHES = 30
_EDGE_BUFFER = 2_000_000


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Other 64-bit hashes of the same shingles, from a first one."""
    h = hashes * np.uint64((2 * lane + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1) | 1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _majority(hashes: np.ndarray) -> bytes:
    """Eight bytes: the bits that over half the hashes have."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; a shorter text is one shingle, one without words none."""
    # bytes.lower() and bytes.split() know ASCII letters and ASCII white space only
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(tokens)
    h64 = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([h64(joined, SEED)] * bool(tokens), np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    return np.fromiter((h64(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def simhash_lanes(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """The fingerprint's eight bytes, and as many more for each lane beyond the first."""
    return b"".join(_majority(_mixed(hashes, lane) if lane else hashes) for lane in range(lanes))


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint."""
    return int.from_bytes(simhash_lanes(shingle_hashes(text, words)), "big")


def _content(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, lanes: int = 1) -> DataFrame:
    """(doc_id, content, key, fp, more, shingles) of each row, without a shuffle.

    fp is the fingerprint as a signed long, more its lanes beyond the first, content a
    hash of the text. With one lane, key is fp and shingles 0; with more, all are of the
    distinct shingles: key is a hash of their set and shingles their number.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, sizes, sets = [], [], []
            for t in batch.column(2):
                hashes = shingle_hashes(t.as_py(), words)
                if lanes > 1:
                    hashes = np.unique(hashes)
                    sets.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                raw.append(simhash_lanes(hashes, lanes))
                sizes.append(len(hashes) if lanes > 1 else 0)
            fps = np.fromiter((int.from_bytes(r[:8], "big") for r in raw), np.uint64, len(raw)).view(np.int64)
            keys = fps if lanes == 1 else np.array(sets, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), pa.array(fps), pa.array([r[8:] for r in raw], pa.binary()), pa.array(sizes, pa.int32())], names=["doc_id", "content", "key", "fp", "more", "shingles"])

    rows = docs.select(F.col(id_col).alias("doc_id"), _content(text_col).alias("content"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, content long, key long, fp long, more binary, shingles int")


def distance(points: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(point)).astype(np.int16)


class VantageTree:
    """Shards of the Hamming space: nodes are (vantage, cuts, children), leaves shard numbers.

    Child k of a node holds distances in [cuts[k], cuts[k + 1]).
    """

    def __init__(self, sample: np.ndarray, most: float):
        self.shards = 0
        self.root = self._grow(np.sort(sample), most, 0)

    def _grow(self, points: np.ndarray, most: float, depth: int):
        if len(points) > max(most, 1) and depth < 64:
            for pick in (0, len(points) // 2, len(points) - 1):
                d = distance(points, points[pick])
                cut = int(np.median(d)) + 1
                cut = cut if (d >= cut).any() else int(d.max())
                left, right = points[d < cut], points[d >= cut]
                if len(left) and len(right) and max(len(left), len(right)) <= 0.95 * len(points):
                    return points[pick], (0, cut, 65), (self._grow(left, most, depth + 1), self._grow(right, most, depth + 1))
        self.shards += 1
        return self.shards - 1

    def deal(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, shard, home): each shard that may hold points within the radius of each point, and the point's own."""
        found: list[tuple] = []
        stack = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while stack:
            node, index, member = stack.pop()
            if isinstance(node, int):
                found.append((index, np.full(len(index), node), member))
                continue
            vantage, cuts, children = node
            d = distance(points[index], vantage)
            for child, low, high in zip(children, cuts[:-1], cuts[1:], strict=True):
                near = (d >= low - radius) & (d < high + radius)
                if near.any():
                    stack.append((child, index[near], (member & (d >= low) & (d < high))[near]))
        index, shard, member = (np.concatenate(x) for x in zip(*found, strict=True))
        home = np.empty(len(points), np.int64)
        home[index[member]] = shard[member]
        return index, shard, home[index]


class Forest:
    """Components of points 0..n-1, kept as labels; edges come in blocks, and `tree` holds those that joined components."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.held: list[np.ndarray] = []
        self.tree: list[np.ndarray] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append(np.stack([a, b]))
        self.size += len(a)
        if self.size > _EDGE_BUFFER:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.held:
            a, b = np.concatenate(self.held, axis=1)
            while True:
                x, y = self.label[a], self.label[b]
                apart = x != y
                if not apart.any():
                    break
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                high, low = np.maximum(x, y), np.minimum(x, y)
                order = np.lexsort((low, high))
                # of each component the edge to the least one
                first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
                self.tree.append(np.where(x[first] > y[first], np.stack([a[first], b[first]]), np.stack([b[first], a[first]])))
                self.label[high[first]] = low[first]
                while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                    self.label = up
            self.held, self.size = [], 0
        return self.label


def _rings(points: np.ndarray) -> list[tuple[tuple, np.ndarray]]:
    """Indices by distance to two vantage points: a tree of two levels with a branch for each distance."""
    if not len(points):
        return []
    first = distance(points, points[0])
    far = int(np.argmin(np.abs(first - 32)))  # about half the bits differ: the two distances tell most
    second = distance(points, points[far])
    key = first.astype(np.int64) * 65 + second
    order = np.argsort(key, kind="stable")
    values, at = np.unique(key[order], return_index=True)
    return [((int(v) // 65, int(v) % 65), part) for v, part in zip(values, np.split(order, at[1:]), strict=True)]


def _near(points: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (a, b) of pairs within the radius: both of group 0, or of different groups."""
    rings = _rings(points)
    ring = np.zeros(len(points), np.int64)
    for i, (_, own) in enumerate(rings):
        ring[own] = i
    here = [own[group[own] != 2] for _, own in rings]
    visiting = [own[group[own] == 2] for _, own in rings]
    for i, ((p, q), _) in enumerate(rings):
        near = [j for j in range(i, len(rings)) if abs(rings[j][0][0] - p) <= radius and abs(rings[j][0][1] - q) <= radius]
        # visitors don't meet one another
        meetings = ((here[i], [here[j] for j in near] + [visiting[j] for j in near]), (visiting[i], [here[j] for j in near[1:]]))
        for own, parts in meetings:
            others = np.concatenate([own[:0], *parts])
            for k in range(0, len(own), 128):
                rows = own[k : k + 128]
                for j in range(0, len(others), 4096):
                    columns = others[j : j + 4096]
                    a, b = np.nonzero(np.bitwise_count(points[rows, None] ^ points[None, columns]) <= radius)
                    a, b = rows[a], columns[b]
                    keep = ((group[a] != group[b]) | (group[a] == 0)) & ((ring[a] != ring[b]) | (group[b] == 2) | (a < b))
                    if keep.any():
                        yield a[keep], b[keep]


def link_cell(points: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """Labels of points: equal if linked by pairs within the radius, both of group 0 or of different groups."""
    forest = Forest(len(points))
    for a, b in _near(points, group, radius):
        forest.add(a, b)
    return forest.settle()


@dataclass
class Lanes:
    """What candidates of a similarity are measured by, beside their first lane."""

    more: np.ndarray  # further lanes, a row a point
    sizes: np.ndarray
    label: np.ndarray  # points of one label are linked already
    refused: np.ndarray  # pairs that aren't, as lower index * n + higher
    most: int  # differing bits of all lanes
    ratio: float


def candidate_pairs(points: np.ndarray, group: np.ndarray, radius: int, lanes: Lanes, each: int | None) -> np.ndarray:
    """Pairs (2, n) that may be similar: of each point `each` at most, or those of a spanning forest."""
    n, forest, found = len(points), Forest(len(points)), []
    taken = np.zeros(n, np.int64)
    for a, b in _near(points, group, radius):
        label = forest.label if each is None else lanes.label
        apart = label[a] != label[b]  # what is together needn't be measured
        a, b = a[apart], b[apart]
        fit = np.minimum(lanes.sizes[a], lanes.sizes[b]) >= lanes.ratio * np.maximum(lanes.sizes[a], lanes.sizes[b])
        a, b = a[fit], b[fit]
        bits = np.bitwise_count(points[a] ^ points[b]) + np.bitwise_count(lanes.more[a] ^ lanes.more[b]).sum(axis=1, dtype=np.int64)
        a, b = a[bits <= lanes.most], b[bits <= lanes.most]
        if len(lanes.refused):
            new = ~np.isin(np.minimum(a, b) * n + np.maximum(a, b), lanes.refused)
            a, b = a[new], b[new]
        if not len(a):
            continue
        if each is None:
            forest.add(a, b)
            forest.settle()
            continue
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        keep = taken[a] + rank < each
        found.append(np.stack([a[keep], b[keep]]))
        taken += np.bincount(a[keep], minlength=n)
    forest.settle()
    return np.concatenate([np.zeros((2, 0), np.int64), *found, *forest.tree], axis=1)


def bits_for(similarity: float, bits: int) -> int:
    """Differing bits of `bits` that texts of this Jaccard similarity of shingles stay within, but for one pair in 700."""
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * angle + 3 * math.sqrt(bits * angle * (1 - angle)))


def size_class(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """Sets of this Jaccard similarity have sizes of one class or of two that follow one another."""
    return np.floor(np.log(np.maximum(shingles, 1)) / -math.log(similarity)).astype(np.int32)


def _dealt(distinct: DataFrame, radius: int, similarity: float | None, sample: int, shard: int) -> DataFrame:
    """Rows of distinct (key, fp, more, shingles, ...) with shard and member, once for each shard they belong to or visit.

    With a similarity, fingerprints are also dealt out by size class: each is a member
    of its own class and visits the next.
    """
    count = distinct.count()
    share = min(1.0, sample / max(count, 1))
    chosen = distinct if share == 1 else distinct.filter(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = chosen.select("fp", "shingles").collect()
    taken = np.array([r.fp for r in rows], np.int64).view(np.uint64)
    # shards of the largest class have the size that is meant
    largest = 1.0 if similarity is None or not rows else np.bincount(size_class(np.array([r.shingles for r in rows]), similarity)).max() / len(rows)
    tree = VantageTree(taken, shard * share / largest)
    names = distinct.columns
    at_fp, at_size = names.index("fp"), names.index("shingles")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(at_fp).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(points):
                continue
            index, to, home = tree.deal(points, radius)
            own = to >= home  # the other direction is the other point's visit
            index_all, place, member = index[own], to[own].astype(np.int64), (to == home)[own]
            if similarity is not None:
                classes = size_class(batch.column(at_size).to_numpy(zero_copy_only=False), similarity).astype(np.int64)
                place = np.concatenate([place + classes[index_all] * tree.shards, to + (classes[index] + 1) * tree.shards])
                member = np.concatenate([member, np.zeros(len(index), bool)])
                index_all = np.concatenate([index_all, index])
            for k in range(0, len(index_all), 100_000):
                part = pa.array(index_all[k : k + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(place[k : k + 100_000]), pa.array(member[k : k + 100_000]), *(c.take(part) for c in batch.columns)], names=["shard", "member", *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema.fields)
    return distinct.mapInArrow(deal, "shard long, member boolean, " + schema)


def _celled(dealt: DataFrame, cell: int, tasks: int) -> DataFrame:
    """dealt with (shard, first, second) of a cell and the row's group in it, a cell's rows together in one of the tasks.

    Shards of over two cells' rows are cut: a cell is a block of members alone (group 0),
    or a block of members (1) with a later one or with a block of visitors (2).
    """
    big = dealt.groupBy("shard").agg(F.count_if("member").alias("members"), F.count("*").alias("rows")).filter(F.col("rows") > 2 * cell)
    blocks = lambda n: F.ceil(n / cell).cast("int")
    cut = durable(big.select("shard", blocks(F.col("members")).alias("own"), blocks(F.col("rows") - F.col("members")).alias("others")))
    joined = dealt.join(F.broadcast(cut) if cut.count() <= BROADCAST_SHARDS else cut, "shard", "left")
    block = lambda n: F.pmod(F.xxhash64("key", F.lit(5)), F.greatest(n, F.lit(1))).cast("int")
    place = lambda first, second, group: F.struct(F.lit(first).alias("first") if isinstance(first, int) else first.alias("first"), F.lit(second).alias("second") if isinstance(second, int) else second.alias("second"), group.alias("group"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda k: k < n)
    own, others = F.col("own"), F.col("others")
    mine, theirs = block(own), block(others)
    of_members = F.concat(
        F.transform(upto(own), lambda k: place(F.least(mine, k), F.greatest(mine, k), F.when(k == mine, 0).when(mine < k, 1).otherwise(2))),
        F.transform(upto(others), lambda k: place(mine, own + k, F.lit(1))),
    )
    of_visitors = F.transform(upto(own), lambda k: place(k, own + theirs, F.lit(2)))
    whole = F.array(place(0, 0, F.when(F.col("member"), 0).otherwise(2)))
    placed = joined.withColumn("place", F.explode(F.when(own.isNull(), whole).when(F.col("member"), of_members).otherwise(of_visitors)))
    rows = placed.select("shard", "place.first", "place.second", "place.group", *[c for c in dealt.columns if c not in ("shard", "member")])
    # so many tasks whatever the bytes: the work of a cell grows with the square of its rows
    return rows.repartition(tasks, "shard", "first", "second")


def _tasks(distinct: DataFrame, shard: int) -> int:
    return max(shuffle_partitions(distinct.sparkSession), min(MOST_TASKS, 2 * distinct.count() // shard))


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD, cell: int = CELL) -> DataFrame:
    """Edges (u, v) of keys: a spanning forest of each component of the distinct (key, fp, shingles) within the radius."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fp", "key"], ignore_index=True)
        keys, points = pdf["key"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64)
        group = pdf["group"].to_numpy(np.int8)
        label = link_cell(points, group, radius) if (group != 2).any() else np.arange(len(pdf))
        linked = label != np.arange(len(label))
        return pd.DataFrame({"u": keys[linked], "v": keys[label[linked]]})

    dealt = _celled(_dealt(distinct.select("key", "fp", "shingles"), radius, None, sample, shard), cell, _tasks(distinct, shard))
    return dealt.groupBy("shard", "first", "second").applyInPandas(link, "u long, v long")


def link_candidates(active: DataFrame, similarity: float, each: int | None, sample: int = SAMPLE, shard: int = SHARD, cell: int = CELL) -> DataFrame:
    """Pairs (u, v) of keys that may reach the similarity, of active (key, fp, more, shingles, label, refused).

    Of each component of candidates a spanning forest; with `each`, so many pairs of a key a cell at
    most, of keys whose labels differ and that `refused` of neither holds.
    """
    radius, most = bits_for(similarity, 64), bits_for(similarity, 64 * LANES)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fp", "key"], ignore_index=True)
        keys, points = pdf["key"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64)
        group, n = pdf["group"].to_numpy(np.int8), len(pdf)
        if not (group != 2).any() or n < 2:
            return pd.DataFrame({"u": keys[:0], "v": keys[:0]})
        order = np.argsort(keys)
        lengths = pdf["refused"].map(len).to_numpy()
        other = np.concatenate([np.zeros(0, np.int64), *pdf["refused"]]).astype(np.int64)
        at = order[np.minimum(np.searchsorted(keys, other, sorter=order), n - 1)]
        mine, here = np.repeat(np.arange(n), lengths), keys[at] == other
        refused = np.unique((np.minimum(mine, at) * n + np.maximum(mine, at))[here])
        lanes = Lanes(np.frombuffer(b"".join(pdf["more"]), np.uint64).reshape(n, -1), pdf["shingles"].to_numpy(), pdf["label"].to_numpy(), refused, most, similarity)
        u, v = candidate_pairs(points, group, radius, lanes, each)
        return pd.DataFrame({"u": keys[u], "v": keys[v]})

    dealt = _celled(_dealt(active, radius, similarity, sample, shard), cell, _tasks(active, shard))
    return dealt.groupBy("shard", "first", "second").applyInPandas(link, "u long, v long")


def shingle_sets(docs: DataFrame, suspects: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(grp, key, fp, more, hashes): suspects (grp, key, fp, more, _id, _content) with the distinct shingles of their row, hashed again."""
    few = suspects.count() <= BROADCAST_SUSPECTS
    rows = docs.select(F.col(id_col).alias("doc_id"), _content(text_col).alias("content"), F.col(text_col).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))
    names = ["grp", "key", "fp", "more"]
    texts = rows.join(F.broadcast(suspects) if few else suspects, same).select(*names, "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in batch.column(4)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], hashes], names=[*names, "hashes"])

    return texts.mapInArrow(hashed, "grp long, key long, fp long, more binary, hashes array<long>")


def judged(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v, alike) of pairs (u, v) by the exact Jaccard similarity of sets (key, hashes).

    A document of many pairs is sent to several tasks, each with a part of them.
    """
    parts = F.ceil(F.count("*") / PAIRS_A_TASK).cast("int")
    busy = pairs.groupBy("v").agg(parts.alias("parts"))
    part = F.pmod(F.xxhash64("u", F.lit(9)), F.col("parts")).cast("int")
    left = pairs.join(busy, "v").select("u", "v", part.alias("part")).join(sets.select(F.col("key").alias("u"), F.col("hashes").alias("a")), "u")
    spread = sets.join(busy, sets["key"] == busy["v"]).select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hashes").alias("b"))
    both = left.join(spread, ["v", "part"])
    common = F.size(F.array_intersect("a", "b"))
    return both.select("u", "v", (common * (1 + similarity) >= similarity * (F.size("a") + F.size("b")) - 1e-9).alias("alike"))


class PrefixIndex:
    """Which sets share one of their rarest elements: alike ones must (rare: in few of these sets).

    A set of n elements whose Jaccard similarity with another is s or more has an element in common with it
    among the rarest n - ceil(s n) + 1 of each, in one order of all elements.
    """

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        values, ids, often = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(values))
        owner, ids, often = np.repeat(np.arange(len(sets)), self.sizes), rank[ids], np.sort(often)
        order = np.lexsort((ids, owner))
        self.ids, starts = ids[order], np.cumsum(self.sizes) - self.sizes
        self.starts, self.values = starts, len(values)
        rarest = self.sizes - np.ceil(similarity * self.sizes - 1e-9).astype(np.int64) + 1
        place = np.arange(len(self.ids)) - np.repeat(starts, self.sizes)
        mine = (place < np.repeat(rarest, self.sizes)) & (often[self.ids] > 1)  # what one set alone has finds nothing
        self.keep(owner[mine], self.ids[mine])
        # a set's own entries, in order of owners
        self.own, self.own_starts = self.ids[mine], np.searchsorted(owner[mine], np.arange(len(sets) + 1))

    def keep(self, owner: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.owner, self.entry = owner[order], ids[order]
        self.first = np.searchsorted(self.entry, np.arange(self.values + 1))

    def drop_closed(self, open_: np.ndarray) -> None:
        live = open_[self.owner]
        self.keep(self.owner[live], self.entry[live])

    def sharing(self, i: int) -> np.ndarray:
        """Owners of entries of set i's rarest elements, repeats included."""
        own = self.own[self.own_starts[i] : self.own_starts[i + 1]]
        a, many = self.first[own], self.first[own + 1] - self.first[own]
        return self.owner[np.repeat(a - (np.cumsum(many) - many), many) + np.arange(many.sum())]

    def common(self, i: int, others: np.ndarray, flag: np.ndarray) -> np.ndarray:
        """How many elements set i has in common with each of the others (none of them empty)."""
        mine = self.ids[self.starts[i] : self.starts[i] + self.sizes[i]]
        many = self.sizes[others]
        ends = np.cumsum(many)
        flag[mine] = True
        there = flag[self.ids[np.repeat(self.starts[others] - (ends - many), many) + np.arange(ends[-1])]]
        flag[mine] = False
        return np.add.reduceat(there, ends - many, dtype=np.int64)


def jaccard_components(sets: list[np.ndarray], fps: np.ndarray, more: np.ndarray, similarity: float, most_work: float = MOST_WORK) -> np.ndarray | None:
    """Labels of sets (distinct hashes each, none empty): equal if linked by pairs that are within the bits of their
    lanes (fps, and a row of `more` each) and of this Jaccard similarity or more. None if that takes more than most_work.

    A search from each set over those not reached yet; what is reached leaves the index.
    """
    radius, most = bits_for(similarity, 64), bits_for(similarity, 64 * LANES)
    index = PrefixIndex(sets, similarity)
    sizes, flag = index.sizes, np.zeros(index.values, bool)
    label, open_ = np.full(len(sets), -1), np.ones(len(sets), bool)
    work, closed, left = 0, 0, len(sets)
    for start in range(len(sets)):
        if not open_[start]:
            continue
        reached, open_[start], label[start] = [start], False, start
        closed, left = closed + 1, left - 1
        while reached and left:
            i = reached.pop()
            found = index.sharing(i)
            work += len(found)
            near = np.unique(found[open_[found]])
            if len(near):
                first = np.bitwise_count(fps[near] ^ fps[i])
                bits = first + np.bitwise_count(more[near] ^ more[i]).sum(axis=1, dtype=np.int64)
                fit = np.minimum(sizes[near], sizes[i]) >= similarity * np.maximum(sizes[near], sizes[i]) - 1e-9
                near = near[(first <= radius) & (bits <= most) & fit]
            if len(near):
                work += int(sizes[near].sum())
                both = index.common(i, near, flag)
                near = near[both * (1 + similarity) >= similarity * (sizes[near] + sizes[i]) - 1e-9]
                label[near], open_[near] = start, False
                reached.extend(near.tolist())
                closed, left = closed + len(near), left - len(near)
            if work > most_work:
                return None
            if 2 * closed > left:
                index.drop_closed(open_)
                closed = 0
        if not left:
            break
    return label


def confirmed_together(grouped_sets: DataFrame, similarity: float) -> DataFrame:
    """(grp, key, root) of keys that are linked, from (grp, key, fp, more, hashes) of components of up to TOGETHER shingles;
    of a component that needs more than MOST_WORK one row, without a key.
    """
    most_work = MOST_WORK

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key").sort_values("key", ignore_index=True)
        keys = pdf["key"].to_numpy(np.int64)
        more = np.frombuffer(b"".join(pdf["more"]), np.uint64).reshape(len(pdf), -1)
        label = jaccard_components([np.asarray(h, np.int64) for h in pdf["hashes"]], pdf["fp"].to_numpy(np.int64).view(np.uint64), more, similarity, most_work)
        if label is None:
            return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "key": [None], "root": [None]})
        linked = np.bincount(label, minlength=len(label))[label] > 1
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "key": keys[linked], "root": keys[label[linked]]})

    return grouped_sets.groupBy("grp").applyInPandas(confirm, "grp long, key long, root long")


def confirmed_by_pairs(points: DataFrame, groups: DataFrame, pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, root) of keys that are linked, from candidate pairs (u, v) and their components (key, grp).

    Each pair is judged by itself. Components with a pair that fails are searched again, for
    pairs of keys that aren't linked yet, until there are none.
    """
    none = F.array().cast("array<long>")
    checked = durable(judged(pairs, sets, similarity))
    unsettled, each = checked.filter("NOT alike"), PAIRS
    for _ in range(MOST_SEARCHES):
        roots = durable(connected_components(checked.filter("alike").select("u", "v")).withColumnRenamed("node", "key"))
        if unsettled.isEmpty():
            return roots
        open_groups = unsettled.select(F.col("u").alias("key")).join(groups, "key").select("grp").distinct()
        groups = durable(groups.join(open_groups, "grp", "left_semi"))
        refused = checked.filter("NOT alike").groupBy("u").agg(F.collect_set("v").alias("refused")).withColumnRenamed("u", "key")
        labelled = points.join(groups, "key", "left_semi").join(roots.withColumnRenamed("root", "label"), "key", "left").join(refused, "key", "left")
        active = durable(labelled.select(*points.columns, F.coalesce("label", "key").alias("label"), F.coalesce("refused", none).alias("refused")))
        unsettled = durable(judged(durable(link_candidates(active, similarity, each).distinct()), sets, similarity))
        checked = durable(checked.union(unsettled))
        each *= PAIRS_GROWTH
    raise RuntimeError(f"candidates haven't settled after {MOST_SEARCHES} searches")


def similar_components(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """(key, root) of the distinct keys that are linked by pairs of this Jaccard similarity or more."""
    points = distinct.select("key", "fp", "more", "shingles")
    fresh = points.withColumns({"label": F.col("key"), "refused": F.array().cast("array<long>")})
    pairs = durable(link_candidates(fresh, similarity, None).distinct())
    groups = connected_components(pairs).withColumnsRenamed({"node": "key", "root": "grp"})
    suspects = durable(distinct.select("key", "fp", "more", "shingles", F.col("rep.doc_id").alias("_id"), F.col("rep.content").alias("_content")).join(groups, "key"))
    large = durable(suspects.groupBy("grp").agg(F.sum("shingles").alias("total")).filter(F.col("total") > TOGETHER).select("grp"))
    none_large = large.isEmpty()
    sets = shingle_sets(docs, suspects.drop("shingles"), id_col, text_col, words)
    if not none_large:
        sets = durable(sets.dropDuplicates(["key"]))
    together = durable(confirmed_together(sets if none_large else sets.join(large, "grp", "left_anti"), similarity))
    heavy = together.filter("key IS NULL").select("grp")
    together = together.filter("key IS NOT NULL").select("key", "root")
    if none_large and heavy.isEmpty():
        return together
    apart = durable(large.union(heavy).distinct())
    own = suspects.join(apart, "grp", "left_semi")
    big = durable(shingle_sets(docs, own.drop("shingles"), id_col, text_col, words).dropDuplicates(["key"])) if none_large else sets.join(apart, "grp", "left_semi")
    members = durable(own.select("key", "grp"))
    by_pairs = confirmed_by_pairs(points, members, pairs.join(members.select(F.col("key").alias("u")), "u", "left_semi"), big.select("key", "hashes"), similarity)
    return durable(together.union(by_pairs))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """(doc_id, content, fp, root, component_id) of each row; rows of a group share root, a key.

    Without `similarity`, fingerprints within `radius` bits are linked. With it, a
    fingerprint has LANES lanes; the vantage-point search is over the first, with the
    radius that its estimate of the similarity needs, all lanes together propose, and
    the exact similarity of distinct shingles decides.
    """
    each = durable(fingerprints(docs, id_col, text_col, words, 1 if similarity is None else LANES))
    distinct = durable(each.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("more").alias("more"), F.first("shingles").alias("shingles"), F.min(F.struct("doc_id", "content")).alias("rep")))
    each = each.select("doc_id", "content", "key", "fp")
    if similarity is None:
        roots = durable(connected_components(link_fingerprints(distinct, radius)).withColumnRenamed("node", "key"))
    else:
        roots = similar_components(docs, distinct, id_col, text_col, words, similarity)
    named = distinct.select("key", "least").join(roots, "key")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.select("key", "root").join(least, "root").select("key", "root", "component_id")
    alone = distinct.join(roots, "key", "left_anti").select("key", F.col("key").alias("root"), F.col("least").alias("component_id"))
    return each.join(linked.union(alone), "key").drop("key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of each row; the component is of fingerprints linked within the radius."""
    return grouped(docs, id_col, text_col, words, radius).select("doc_id", "fp", "component_id")


def hex_digits(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """The rows of docs with all columns, less all but one row of each group of near duplicates.

    The row with the least id stays (rows without one come last), of equal ids one
    text, of rows that repeat both the one whose other columns come first as JSON.
    """
    rows = durable(grouped(docs, id_col, text_col, words, radius, similarity).select("doc_id", "content", "root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "content")).alias("first")
    kept = durable(rows.groupBy("root").agg(first).select(F.col("first.doc_id").alias("_kept"), F.col("first.content").alias("_content")))
    same = F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("content") == F.col("_content"))
    repeated = rows.join(kept, same, "left_semi").count() > kept.count()
    whole = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("doc_id"), _content(text_col).alias("content"))
    out = whole.join(kept, same, "left_semi")
    if repeated:
        out = out.groupBy("doc_id", "content").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return out.select("_row.*")


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
