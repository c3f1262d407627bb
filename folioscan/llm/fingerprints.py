"""Quartile bucket digests of documents.

Every run of three bytes of a text is hashed into one of 256 buckets. A
digest holds, for each bucket, which quartile of all buckets its count falls
in (two bits), the length on a logarithmic scale and two quartile ratios.
Digests of similar texts differ in few quartiles.

Null text counts as empty, a text under three bytes has no triplets and all
its buckets are in the lowest quartile; equal texts always have equal digests.
Rows that repeat both id and text stand next to one another, in any order.
Extra columns are ignored, repeated rows give repeated results, and an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, table

BUCKETS = 256
#: Difference of two buckets whose quartiles are 0, 1, 2 or 3 apart.
STEP_COST = np.array([0, 1, 2, 6])
#: Two unrelated texts differ by 1.6 a bucket on average; from here on they count as unlike.
MAX_DIFFERENCE = 2 * BUCKETS
MAX_LENGTH_COST = 24
MAX_RATIO_COST = 16
_LOWEST = -(2**63)


def bucket_counts(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(BUCKETS, np.int64)
    triplets = a[:-2] | (a[1:-1] << np.uint32(8)) | (a[2:] << np.uint32(16))
    return np.bincount((triplets * np.uint32(0x9E3779B1)) >> np.uint32(24), minlength=BUCKETS)


def digest(text: str) -> str:
    """132 hex digits: length, quartile ratios, 256 quartiles of two bits."""
    data = text.encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    quartiles = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    packed = (quartiles << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1, dtype=np.uint8)
    length = min(255, round(12 * math.log1p(len(data))))
    ratios = ((16 * q1 // (q3 + 1)) << 4) | (16 * q2 // (q3 + 1)) if q3 else 0
    return bytes([length, min(ratios, 255)]).hex() + packed.tobytes().hex()


def _unpacked(value: str) -> tuple[int, int, int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(value), np.uint8)
    body = (raw[2:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
    return int(raw[0]), int(raw[1]) >> 4, int(raw[1]) & 15, body.ravel().astype(np.int8)


def difference(a: str, b: str) -> int:
    """0 for equal digests, MAX_DIFFERENCE at most."""
    (la, ra, sa, xa), (lb, rb, sb, xb) = _unpacked(a), _unpacked(b)
    body = int(STEP_COST[np.abs(xa - xb)].sum())
    length = min(MAX_LENGTH_COST, max(0, abs(la - lb) - 1))
    ratios = min(MAX_RATIO_COST, abs(ra - rb) + abs(sa - sb))
    return min(MAX_DIFFERENCE, body + length + ratios)


def likeness(a: str, b: str) -> float:
    return 1 - difference(a, b) / MAX_DIFFERENCE


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each row, without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [digest(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def with_following(docs: DataFrame, slots: int | None = None) -> DataFrame:
    """Rows (slot, borrowed, key, tie, doc_id, text) dealt out so that each slot, read in
    order, is followed by the next row of the whole table by descending doc_id.

    There are as many slots as shuffle partitions or as partitions of the input, whichever
    are more. One pass over the ids finds range bounds; the texts are shuffled once. The first
    row of the next slot is sent along as well (borrowed); after the last slot, the
    first of all. Null ids come last, equal ids in the order of a hash of their text; an
    id that fills several slots is cut by that hash.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(_LOWEST)).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    slots = slots or max(shuffle_partitions(spark), docs.rdd.getNumPartitions())
    at = [k / slots for k in range(1, slots)]
    bounds = Counter(keyed.select(F.col("key").cast("double")).approxQuantile("key", at, 1 / (4 * slots)) if at else [])
    splits = [-math.inf, *sorted(set(bounds) - {-math.inf, math.inf}), math.inf]
    keyed = keyed.withColumn("as_double", F.col("key").cast("double"))
    dealt = Bucketizer(splits=splits, inputCol="as_double", outputCol="bucket").transform(keyed) if len(splits) > 2 else keyed.withColumn("bucket", F.lit(0.0))
    # an id that is a bound several times opens its bucket: ids below it (only of the same double), parts of it, ids above
    hot = [(float(splits.index(v)), int(v), n) for v, n in sorted(bounds.items()) if n > 1]
    parts = max((n for *_, n in hot), default=0)
    part = F.lit(0)
    if hot:
        dealt = dealt.join(F.broadcast(spark.createDataFrame(hot, "bucket double, value long, n int")), "bucket", "left")
        own = F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * F.col("n")).cast("int")
        within = F.when(F.col("key") < F.col("value"), F.lit(0)).when(F.col("key") > F.col("value"), F.lit(parts + 1)).otherwise(F.least(own, F.col("n") - 1) + 1)
        part = F.when(F.col("value").isNull(), F.lit(0)).otherwise(within)
    dealt = dealt.select("doc_id", "text", "key", "tie", (F.col("bucket").cast("long") * (parts + 2) + part).alias("code"))
    # one row for each slot: the first in reading order
    first = sorted((r.code, r.top.key, r.top.tie) for r in dealt.groupBy("code").agg(F.max(F.struct("key", "tie")).alias("top")).collect())
    numbers = spark.createDataFrame([(code, k) for k, (code, _, _) in enumerate(first)], "code long, slot int")
    lent = [(first[k][1], first[k][2], (k + 1) % len(first)) for k in range(len(first))]
    to = spark.createDataFrame(lent, "first_key long, first_tie long, borrower int")
    numbered = dealt.join(F.broadcast(numbers), "code")
    both = numbered.join(F.broadcast(to), (F.col("key") == F.col("first_key")) & (F.col("tie") == F.col("first_tie")), "left")
    own = F.struct(F.col("slot").alias("slot"), F.lit(0).alias("borrowed"))
    borrowed = F.struct(F.col("borrower").alias("slot"), F.lit(1).alias("borrowed"))
    both = both.withColumn("place", F.explode(F.when(F.col("borrower").isNull(), F.array(own)).otherwise(F.array(own, borrowed))))
    rows = both.select("place.slot", "place.borrowed", "key", "tie", "doc_id", "text")
    return rows.repartitionById(max(len(first), 1), F.col("slot")).sortWithinPartitions(F.col("slot"), F.col("borrowed"), F.col("key").desc(), F.col("tie").desc())


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness (EDITED).

    The edited text has its last floor(n / 2) code points replaced by the first as
    many of the document that follows by descending doc_id. Takes doc_id and text.
    """
    names = [x.split()[0] for x in EDITED.split(", ")]
    schema = pa.schema([(n, pa.int64() if n in ("doc_id", "n_chars") else pa.float64() if n.startswith("near") else pa.string()) for n in names])

    def result(doc_id, text: str, own: str, following: str, next_digest: str) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        changed = digest(edited) if half else own
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), sha, own, changed, likeness(own, changed), likeness(own, next_digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (slot, doc_id, text, digest) of the row that waits for the next
        for batch in batches:
            out = []
            for slot, borrowed, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("slot", "borrowed", "doc_id", "text")), strict=True):
                text = text or ""
                own = digest(text)
                if before is not None and before[0] == slot:
                    out.append(result(*before[1:], text, own))
                before = None if borrowed else (slot, doc_id, text, own)
            for k in range(0, len(out), 5000):
                columns = zip(*out[k : k + 5000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return with_following(docs.select("doc_id", "text")).select("slot", "borrowed", "doc_id", "text").mapInArrow(run, EDITED)


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
