"""Spelling variants: words at Levenshtein distance one, grouped under their most frequent form.

1. Words are counted in each task, then over all: a row a task and word is shuffled.
2. Words are sorted by range; each stretch of them becomes a compact trie: a node for each
   prefix that several words share, a leaf with its tail for each word alone.
3. Shards are broadcast in waves of at most WAVE_BYTES. Each task runs its words' distance-one
   automata against every shard of the wave, depth first, in blocks of states. A state
   (word, place, edits, node) follows a match, a replaced, an inserted or a deleted letter; what
   accepts is a near word. A task keeps a count and the best form a word, never pairs.
4. Waves are added up: near words are counted, the form is the most frequent, then the least.
5. Roots are found by pointer doubling along forms, whose counts grow fivefold a step.

Letters are those below U+0100, so a letter is a byte. Null and empty texts have no words; a null
id counts as an empty one in the contract's edit. Repeated rows count as often as they stand.
Ties of counts go to the word that comes first in code-point order. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, shuffle_partitions, table

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent as its variant.
TIMES = 5
#: One run in so many loses a letter in the contract's edit.
EDITED = 199
#: Words of a shard, at most, and its bytes (a longer word has a shard of its own); bytes of a wave of shards.
SHARD_WORDS = 1 << 16
SHARD_BYTES = 1 << 22
WAVE_BYTES = 1 << 26
#: Words whose automata run at a time; states that are stepped at a time; words counted before a task emits them.
BLOCK_WORDS = 1 << 11
BLOCK_STATES = 1 << 18
HELD_WORDS = 200_000
MOST_ROUNDS = 64

#: Bytes of Latin-1: A-Z lower-cased, letters kept, all else blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of_letters(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF as Latin-1, A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def edited(run: bytes, start: int) -> bytes:
    """The run, less a letter if EDITED divides the hash; start is the crc32 of what precedes the run."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % EDITED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: bool = True, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of least_letters letters that occur least_count times. A row a task and word is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32((f"{doc_id.as_py()}:" if doc_id.is_valid else ":").encode())
                for w, n in Counter(runs_of_letters(text.as_py())).items():
                    if len(w) < least_letters:
                        continue  # an edit only shortens
                    if edit:
                        w = edited(w, start)
                        if len(w) < least_letters:
                            continue
                    held[w] += n
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Trie:
    """A compact trie over sorted distinct words of bytes.

    Nodes are numbered level by level, so the children of a node follow one another and
    (parent, letter) grows with the number. Node v holds words low[v] to high[v] - 1; with one word it is a leaf.
    """

    def __init__(self, words: list[bytes]):
        self.words = len(words)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.letters = np.frombuffer(b"".join(words), np.uint8)
        low, high, keys = [np.zeros(1, np.int64)], [np.full(1, len(words), np.int64)], [np.zeros(0, np.int64)]
        # words of nodes that several share, with their node
        open_, node = (np.arange(len(words)), np.zeros(len(words), np.int64)) if len(words) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        depth, nodes = 0, 1
        while len(open_):
            longer = self.size[open_] > depth
            open_, node = open_[longer], node[longer]
            if not len(open_):
                break
            key = node << 8 | self.letters[self.at[open_] + depth]
            first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            many = np.diff(np.append(first, len(key)))
            keys.append(key[first])
            low.append(open_[first])
            high.append(open_[first] + many)
            node = np.repeat(nodes + np.arange(len(first)), many)
            nodes += len(first)
            shared = np.repeat(many > 1, many)
            open_, node, depth = open_[shared], node[shared], depth + 1
        self.low, self.high, self.keys = np.concatenate(low), np.concatenate(high), np.concatenate(keys)
        self.first = np.searchsorted(self.keys, np.arange(nodes + 1, dtype=np.int64) << 8) + 1  # first child of each node

    def child(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have a child by the letter, and these children."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = node << 8 | letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = np.nonzero(self.keys[at] == key)[0]
        return there, at[there] + 1


class Queries:
    """Words whose automata run: letters in one array."""

    def __init__(self, words: list[bytes]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.letters = np.frombuffer(b"".join(words) + b"\0\0", np.uint8)


def _tails(trie: Trie, q: Queries, word, place, edits, leaf, depth: int) -> np.ndarray:
    """Which states at leaves accept: what is left of the query against the leaf's tail, letter by letter."""
    target = trie.low[leaf]
    left, tail = q.size[word] - place, trie.size[target] - depth
    fit = np.nonzero(np.where(edits == 1, left == tail, np.abs(left - tail) <= 1))[0]
    i, j = q.at[word[fit]] + place[fit], trie.at[target[fit]] + depth
    left, tail, edits = left[fit], tail[fit], edits[fit].copy()
    accepted = []
    while len(fit):
        ended = (left == 0) | (tail == 0)
        if ended.any():
            # one letter that is left over is the edit
            good = ended & np.where(edits == 1, (left == 0) & (tail == 0), left + tail == 1)
            accepted.append(fit[good])
            go = ~ended
            fit, i, j, left, tail, edits = fit[go], i[go], j[go], left[go], tail[go], edits[go]
            if not len(fit):
                break
        same = q.letters[i] == trie.letters[j]
        # the one edit: the lengths tell which
        drop_query = same | (left >= tail)
        drop_target = same | (tail >= left)
        go = same | (edits == 0)
        edits = np.where(same, edits, 1)
        i, left = i + drop_query, left - drop_query
        j, tail = j + drop_target, tail - drop_target
        if not go.all():
            fit, i, j, left, tail, edits = fit[go], i[go], j[go], left[go], tail[go], edits[go]
    return np.concatenate([np.zeros(0, np.int64), *accepted])


def near_words(trie: Trie, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(query, word of the trie) of all pairs at distance one: automata and trie are intersected depth first, in blocks of states."""
    n = len(q.size)
    zero = np.zeros(n, np.int64)
    stack = [(0, np.arange(n), zero, np.zeros(n, np.int8), zero)]
    found = [np.zeros(0, np.int64)]

    def accept(word, target):
        found.append(word * trie.words + target)

    while stack:
        depth, word, place, edits, node = stack.pop()
        if len(word) > BLOCK_STATES:
            half = len(word) // 2
            stack += [(depth, *(x[:half] for x in (word, place, edits, node))), (depth, *(x[half:] for x in (word, place, edits, node)))]
            continue
        leaf = trie.high[node] - trie.low[node] == 1
        if leaf.any():
            own = np.nonzero(leaf)[0]
            hit = own[_tails(trie, q, word[own], place[own], edits[own], node[own], depth)]
            accept(word[hit], trie.low[node[hit]])
            inner = ~leaf
            word, place, edits, node = word[inner], place[inner], edits[inner], node[inner]
            if not len(word):
                continue
        left = q.size[word] - place
        ends = (trie.size[trie.low[node]] == depth) & (left + edits == 1)  # a word ends here; a last letter may be deleted
        accept(word[ends], trie.low[node[ends]])
        used = edits == 1
        here = q.at[word] + place
        # after the edit: only the letter itself
        a = np.nonzero(used & (left > 0))[0]
        there, child = trie.child(node[a], q.letters[here[a]])
        a = a[there]
        parts = [(word[a], place[a] + 1, edits[a], child)]
        b = np.nonzero(~used)[0]
        if len(b):
            # a deleted letter, then the next one
            d = b[left[b] > 1]
            there, child = trie.child(node[d], q.letters[here[d] + 1])
            d = d[there]
            parts.append((word[d], place[d] + 2, np.ones(len(d), np.int8), child))
            # every child: the letter itself, a replaced one, or an inserted one before it
            many = trie.first[node[b] + 1] - trie.first[node[b]]
            of = np.repeat(b, many)
            child = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(trie.first[node[b]], many)
            letter = trie.keys[child - 1] & 255
            more = left[of] > 0
            same = more & (letter == q.letters[here[of]])
            other = np.nonzero(~same)[0]
            replaced = other[more[other]]
            same = np.nonzero(same)[0]
            parts.append((word[of[same]], place[of[same]] + 1, np.zeros(len(same), np.int8), child[same]))
            parts.append((word[of[replaced]], place[of[replaced]] + 1, np.ones(len(replaced), np.int8), child[replaced]))
            parts.append((word[of[other]], place[of[other]], np.ones(len(other), np.int8), child[other]))
        state = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        if len(state[0]):
            stack.append((depth + 1, *state))
    pairs = np.unique(np.concatenate(found))
    return pairs // max(trie.words, 1), pairs % max(trie.words, 1)


def shards(words: DataFrame, shard_words: int = SHARD_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(first, bytes, words, n): stretches of the sorted words (word, n), letters joined by line feeds and counts as int64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        counts: list[int] = []
        size = 0

        def out() -> pa.RecordBatch:
            blob = b"\n".join(held)
            arrays = [pa.array([held[0].decode("latin-1")]), pa.array([len(blob) + 8 * len(counts)]), pa.array([blob]), pa.array([np.array(counts, np.int64).tobytes()])]
            return pa.RecordBatch.from_arrays(arrays, names=["first", "bytes", "words", "n"])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = word.encode("latin-1")
                if held and (len(held) >= shard_words or size + len(w) > shard_bytes):
                    yield out()
                    held, counts, size = [], [], 0
                held.append(w)
                counts.append(n)
                size += len(w)
        if held:
            yield out()

    ordered = words.select("word", "n").repartitionByRange(shuffle_partitions(words.sparkSession), "word").sortWithinPartitions("word")
    return ordered.mapInArrow(run, "first string, bytes long, words binary, n binary")


def _against(words: DataFrame, wave: list[tuple[bytes, bytes]]) -> DataFrame:
    """(word, n, n_near, form_n, form) of all words against the shards of one wave, which is broadcast."""
    shared = words.sparkSession.sparkContext.broadcast(wave)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [(blob, Trie(blob.split(b"\n")), np.frombuffer(counts, np.int64)) for blob, counts in shared.value]
        for whole in batches:
            for k in range(0, whole.num_rows, BLOCK_WORDS):
                batch = whole.slice(k, BLOCK_WORDS)
                q = Queries([w.encode("latin-1") for w in batch.column(0).to_pylist()])
                near, best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                form: list[str | None] = [None] * batch.num_rows
                for _, trie, counts in tries:  # in order of words, so that of equal counts the first one stays
                    word, target = near_words(trie, q)
                    if not len(word):
                        continue
                    near += np.bincount(word, minlength=len(near))
                    order = np.lexsort((target, -counts[target], word))
                    first = order[np.concatenate([[True], word[order][1:] != word[order][:-1]])]
                    for w, t in zip(word[first].tolist(), target[first].tolist(), strict=True):
                        if counts[t] > best[w]:
                            best[w] = counts[t]
                            form[w] = trie.letters[trie.at[t] : trie.at[t + 1]].tobytes().decode("latin-1")
                arrays = [batch.column(0), batch.column(1), pa.array(near), pa.array(best), pa.array(form, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["word", "n", "n_near", "form_n", "form"])

    return words.mapInArrow(run, "word string, n long, n_near long, form_n long, form string")


def _waves(found: DataFrame, wave_bytes: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """The shards, in order, a wave at a time: what the driver holds at once is bounded."""
    sizes = found.select("first", "bytes").sort("first").collect()
    k = 0
    while k < len(sizes):
        to, total = k + 1, sizes[k]["bytes"]
        while to < len(sizes) and total + sizes[to]["bytes"] <= wave_bytes:
            total += sizes[to]["bytes"]
            to += 1
        rows = found.filter(F.col("first").between(sizes[k]["first"], sizes[to - 1]["first"])).collect()
        yield [(bytes(r["words"]), bytes(r["n"])) for r in sorted(rows, key=lambda r: r["first"])]
        k = to


def nearest_forms(words: DataFrame, wave_bytes: int = WAVE_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n, n_near, best, best_n) of distinct words (word, n): how many words are near, and the most frequent of these."""
    words = durable(words.select("word", "n"))
    found = durable(shards(words, shard_words))
    spread = words.repartition(shuffle_partitions(words.sparkSession), "word")
    parts = [durable(_against(spread, wave)) for wave in _waves(found, wave_bytes)]
    if not parts:
        return words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n"))
    if len(parts) == 1:
        rows = parts[0].withColumn("best", F.struct((-F.col("form_n")).alias("less"), "form"))
    else:
        every = parts[0]
        for part in parts[1:]:
            every = every.union(part)
        least = F.min(F.when(F.col("n_near") > 0, F.struct((-F.col("form_n")).alias("less"), "form")))
        rows = every.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), least.alias("best"))
    near = F.col("n_near") > 0
    return rows.select("word", "n", "n_near", F.when(near, F.col("best.form")).alias("best"), F.when(near, -F.col("best.less")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): the last word that forms lead to. Counts grow along forms, so there is no ring."""
    reached = durable(links.select("word", F.col("form").alias("root")))
    for _ in range(MOST_ROUNDS):
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = durable(reached.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reached = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return reached
    raise RuntimeError(f"forms haven't ended after {MOST_ROUNDS} rounds")


def spelling_variants(words: DataFrame, times: int = TIMES, **limits) -> DataFrame:
    """word, n, n_near, form, form_n, root of distinct words (word, n); other limits as in nearest_forms."""
    near = nearest_forms(words, **limits)
    fits = F.col("best_n") >= times * F.col("n")
    found = durable(near.select("word", "n", "n_near", F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")))
    ends = roots(found.filter(F.col("form").isNotNull()).select("word", "form"))
    return found.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))
