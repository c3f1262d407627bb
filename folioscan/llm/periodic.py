"""Periodic runs of words by Karp-Miller-Rosenberg naming.

Level k names each window of 2**k words: equal names, equal windows. A level is made of
pairs of names of the one below, by sorting; windows that occur once need no further name,
and the levels end where none occurs twice. How far two places agree (LCE), forwards or
backwards, is read off by descending the levels.

A run of period q has at least 4 q words, so its stretch of places that agree with the place
q words on has 3 q; for 2**k <= q < 2**(k + 1) a grid with steps of 3 q - 2**k + 1 hits a window
of 2**k words inside it. Grid places whose level-k name is that of the place q words on are
candidates, extended both ways by LCE. A stretch found with several periods keeps the least:
by Fine and Wilf the others are its multiples. No hashes, no suffix sorting.

Each text is one unit of work within a task, nothing is shuffled. Memory: some 4 bytes a word and level,
20 levels for a text of a million words that is periodic throughout, 3 to 5 for prose.

Null and empty texts have no words and no runs. Rows with a null id are never edited in
`op12_periodic_runs`. Repeated rows get equal results, ties go to the least start, then the
least period; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Words a run has at least, and as many times its period.
LEAST_WORDS = 6
LEAST_TIMES = 4
#: Candidates that are extended at a time.
BLOCK = 1 << 18


def name_levels(names: np.ndarray) -> list[np.ndarray]:
    """Names of the windows of 1, 2, 4, ... words at each place, as long as some window occurs twice."""
    levels: list[np.ndarray] = []
    while len(names):
        twice = np.bincount(names)[names] > 1
        if not twice.any():
            break
        levels.append(names)
        w = 1 << (len(levels) - 1)
        n = len(names) - w
        if n <= 0:
            break
        at = np.nonzero(twice[:n] & twice[w:])[0]
        pairs = names[at].astype(np.int64) << 32 | names[at + w]
        named, again = np.unique(pairs, return_inverse=True)
        names = np.arange(len(named), len(named) + n, dtype=np.int32)  # those that occur once
        names[at] = again
    return levels


def agree_forwards(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from place i on equal those from place j > i on."""
    start, i, j = i, i.copy(), j.copy()
    for k in range(len(levels) - 1, -1, -1):
        names = levels[k]
        fits = j < len(names)
        here = np.nonzero(fits)[0]
        same = here[names[i[here]] == names[j[here]]]
        i[same] += 1 << k
        j[same] += 1 << k
    return i - start


def agree_backwards(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before place i equal those before place j > i."""
    start, i, j = i, i.copy(), j.copy()
    for k in range(len(levels) - 1, -1, -1):
        w, names = 1 << k, levels[k]
        here = np.nonzero(i >= w)[0]
        same = here[names[i[here] - w] == names[j[here] - w]]
        i[same] -= w
        j[same] -= w
    return start - i


def _grid(n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (place, period) of the grids of periods 2**k to 2**(k + 1) - 1 in n words."""
    w = 1 << k
    periods = np.arange(w, min(2 * w - 1, n // LEAST_TIMES) + 1)
    if not len(periods):
        return
    steps = (LEAST_TIMES - 1) * periods - w + 1
    sizes = np.maximum((n - periods - w) // steps + 1, 0)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(periods):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
        own = sizes[at:to]
        first = np.repeat(np.cumsum(own) - own, own)
        yield (np.arange(own.sum()) - first) * np.repeat(steps[at:to], own), np.repeat(periods[at:to], own)
        at = to


def runs_of(names: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs, a row each, by start, then period. names: equal numbers for equal words."""
    found, n = [np.zeros((0, 3), np.int64)], len(names)
    if n >= LEAST_WORDS:
        levels = name_levels(names)
        for k in range(len(levels)):
            for at, period in _grid(n, k):
                same = np.nonzero(levels[k][at] == levels[k][at + period])[0]
                if not len(same):
                    continue
                i, q = at[same], period[same]
                start = i - agree_backwards(levels, i, i + q)
                end = i + q + agree_forwards(levels, i, i + q)
                long = end - start >= np.maximum(LEAST_WORDS, LEAST_TIMES * q)
                if long.any():
                    found.append(np.unique(np.stack([start, end - start, q], axis=1)[long], axis=0))
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    if len(every) > 1:
        again = (every[1:, 0] == every[:-1, 0]) & (every[1:, 1] == every[:-1, 1])
        every = every[np.concatenate([[True], ~again])]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray | None:
    """Places of words that no run holds after its first period; None if that is all."""
    if not len(runs):
        return None
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.nonzero(np.cumsum(steps[:-1]) == 0)[0]


def repeated_tail(n: int, doc_id: int) -> np.ndarray | None:
    """Places whose words stand at 0..n-1 once the contract's edit is made; None if the text isn't edited."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _names(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit=None, texts: bool = False) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period), collapsed_sha256 of each row.

    edit(n, doc_id) gives the places whose words take places 0..n-1 before runs are sought (None: as they are).
    With texts, `collapsed` holds the text of the words that no run holds after its first period.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one(doc_id, text: str | None) -> tuple[int, np.ndarray, bytes]:
        words = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: ASCII white space alone
        names = _names(words)
        at = edit(len(words), doc_id) if edit is not None and doc_id is not None else None
        runs = runs_of(names if at is None else names[at])
        kept = kept_words(len(words), runs)
        if at is not None:
            kept = at if kept is None else at[kept]
        return len(words), runs, b" ".join(words if kept is None else [words[k] for k in kept.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                n, runs, collapsed = one(doc_id.as_py(), text.as_py())
                rows.append((n, runs, hashlib.sha256(collapsed).hexdigest(), collapsed.decode("utf-8", "surrogatepass") if texts else None))
            every = np.concatenate([np.zeros((0, 3), np.int64), *(r[1] for r in rows)])
            ends = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(every[:, c])) for c in range(3)], fields=list(run_type))
            arrays = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), items), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array([r[3] for r in rows], pa.string())] * texts, names=["doc_id", "n_words", "runs", "collapsed_sha256"] + ["collapsed"] * texts)

    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_sha256 string" + ", collapsed string" * texts
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), edit=repeated_tail)
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    best = found.select("*", first.alias("first"), text.alias("_lines"))
    length = -F.col("first.less")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("first.start").alias("start"), length.alias("length"), F.col("first.period").alias("period"),
        F.floor(1000 * length / F.col("first.period")).cast("long").alias("exponent_milli"), F.sha2(F.col("_lines"), 256).alias("runs_sha256"), "collapsed_sha256", "n_words",
    )
