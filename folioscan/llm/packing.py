"""Bounded-space online packing of tokenised documents into fixed windows.

Each partition keeps a fixed number of open windows. A document's remainder
goes to the open window it fits best; when it fits none, the fullest is
topped up with the head of the document (cuts are free) and emitted. At its
end a partition closes its open windows into full ones and one leftover;
leftovers of all partitions are merged in groups of bounded size.

Null text is empty: its only id is the end id. Null or repeated doc_ids and
repeated rows are packed like any others, each row on its own. Very long
texts become full windows and a remainder. Of windows that fit equally well the one
opened first is taken, of equally full ones too. Extra columns are ignored. An empty
table gives no pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, table

WINDOW = 2048
OPEN_WINDOWS = 16
#: A gap under so many tokens is padded rather than filled with a cut.
LEAST_CUT = 16
END_ID = 1
#: Leftover windows that one task merges.
MERGE_GROUP = 4096
END_OF_TEXT = "<|endoftext|>"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, leftover boolean"
_SCHEMA = pa.schema([(x.split()[0], pa.bool_() if x.endswith("boolean") else pa.int64()) for x in PIECES.split(", ")])
_encoders: dict[tuple[str, str], object] = {}


def tokenizer_files() -> tuple[str, str]:
    """The vocabulary as the tokenizers library reads it, and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of the tokenizer file `json_path`, computed from the same vocabulary's ranks.

    The rank encoder gives the same ids several times as fast; texts that it can't
    take (runs too long for its pattern) go through the tokenizer itself.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.exact = Tokenizer.from_file(json_path)
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if END_OF_TEXT in text:  # one id in the tokenizer
            return self.exact.encode(text, add_special_tokens=False).ids
        try:
            return self.fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # a panic of the pattern engine isn't an Exception
            return self.exact.encode(text, add_special_tokens=False).ids


def encoder(json_path: str, ranks_path: str) -> Encoder:
    key = (json_path, ranks_path)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


class Packer:
    """Packs a stream of documents; full windows go to `rows`, the last partial one on close."""

    def __init__(self, first_id: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT):
        self.window, self.most_open, self.least_cut = window, open_windows, least_cut
        self.next_id, self.rows = first_id, []
        self.open: list[list] = []  # [tokens held, [(doc_id, start, ids, doc_tokens)]]

    def emit(self, pieces: list[tuple], leftover: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset, leftover))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self.emit([(doc_id, start, ids[start : start + self.window], total)])
            start += self.window
        if start < total:
            self.place(doc_id, start, ids[start:].copy(), total)

    def place(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        n = len(ids)
        best = max((w for w in self.open if w[0] + n <= self.window), key=lambda w: w[0], default=None)
        if best is None and len(self.open) >= self.most_open:
            fullest = max(self.open, key=lambda w: w[0])
            gap = self.window - fullest[0]
            self.open.remove(fullest)
            if gap >= self.least_cut:
                self.emit([*fullest[1], (doc_id, start, ids[:gap], total)])
                return self.place(doc_id, start + gap, ids[gap:], total)
            self.emit(fullest[1])
        if best is None:
            self.open.append([n, [(doc_id, start, ids, total)]])
            return None
        best[0] += n
        best[1].append((doc_id, start, ids, total))
        if best[0] == self.window:
            self.open.remove(best)
            self.emit(best[1])
        return None

    def close(self) -> None:
        """Fill windows from the open ones, the fullest first; what remains is one leftover."""
        held, pieces = 0, []
        for _, window in sorted(self.open, key=lambda w: -w[0]):
            for doc_id, start, ids, total in window:
                while held + len(ids) >= self.window:
                    gap = self.window - held
                    self.emit([*pieces, (doc_id, start, ids[:gap], total)])
                    held, pieces, start, ids = 0, [], start + gap, ids[gap:]
                if len(ids):
                    pieces.append((doc_id, start, ids, total))
                    held += len(ids)
        self.open = []
        if pieces:
            self.emit(pieces, leftover=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def merge_leftovers(pieces: DataFrame, window: int = WINDOW, group: int = MERGE_GROUP) -> DataFrame:
    """The leftover windows (one for each partition at most) put together, first fit by falling size."""

    def placed(pdf):
        bins: list[list[int]] = []  # [held, its sequence_id]
        out = []
        for n, seq in sorted(zip(-pdf["held"], pdf["sequence_id"], strict=True)):
            to = next((b for b in bins if b[0] - n <= window), None)
            if to is None:
                bins.append(to := [0, seq])
            out.append((seq, to[1], to[0]))
            to[0] -= n
        return pd.DataFrame(out, columns=["sequence_id", "merged_id", "shift"])

    held = pieces.groupBy("sequence_id").agg(F.sum("length").alias("held"))
    # sequence ids hold the partition in their upper bits
    by = F.floor(F.shiftright("sequence_id", 32) / group).alias("merge_group")
    places = held.groupBy(by).applyInPandas(placed, "sequence_id long, merged_id long, shift long")
    moved = pieces.join(places, "sequence_id")
    return moved.withColumns({"sequence_id": F.col("merged_id"), "offset": F.col("offset") + F.col("shift")}).select(*pieces.columns)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str] | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `files`: see tokenizer_files(); every executor reads them by these paths. No text
    is shuffled. The pieces are written to the checkpoint folder once, as they are read twice.
    """
    json_path, ranks_path = files or tokenizer_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path).ids
        packer = Packer(TaskContext.get().partitionId() << 32, window, open_windows, least_cut)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                packer.add(doc_id, np.array(ids, "<u4"))
                if len(packer.rows) >= 20_000:
                    yield _batch(packer.rows)
                    packer.rows = []
        packer.close()
        if packer.rows:
            yield _batch(packer.rows)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = durable(docs.mapInArrow(run, PIECES))
    whole = pieces.filter(~F.col("leftover"))
    merged = merge_leftovers(pieces.filter("leftover"), window)
    return whole.unionByName(merged).drop("leftover")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
