"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed character n-grams (1 to 3, over lower-case
letters and gaps between words), of unit length. Each language has several
centroids, found by spherical k-means; the language of the most similar
centroid by cosine is predicted (of equal ones, that of the first language by name).
A text is rejected if it is less similar than texts of its length were in training, less
a margin: cosines grow with length, of real texts as of junk.

The model is fitted to a bounded sample: at most PER_LANGUAGE labelled texts of
each language, those with the least hashes, whole; each language's centroids are
found on the executors. Everything else - every prediction - covers whole texts of all rows.
More than MOST_LANGUAGES different labels are an error: the model would not fit a worker.

Null texts and texts without a letter are `und`, score 0, rejected. Rows with a
null id are never learned from. Repeated rows are predicted alike; extra columns
are ignored. An empty or unlabelled table gives `und` for every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, table

DIMENSIONS = 1 << 13
NGRAMS = (1, 2, 3)
#: Training texts of a language, at most; languages, at most (a model of about 100 MB).
PER_LANGUAGE = 200
MOST_LANGUAGES = 1000
CENTROIDS = 3
#: Rejected if the cosine is under this share of the least similar hundredth of the training texts
#: with as many n-grams; in the first class, and where too few texts tell, under SHORT_SHARE of that of all.
REJECT_SHARE = 0.5
SHORT_SHARE = 0.3
LENGTHS = np.array([300, 1000, 4000])
LEAST_TEXTS = 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_CHUNK = 1 << 20


def counts(text: str) -> np.ndarray:
    """How often each dimension's n-grams occur in the whole text."""
    total = np.zeros(DIMENSIONS, np.float64)
    text = text.lower()
    held = np.zeros(0, np.uint32)
    for k in range(0, len(text), _CHUNK):  # the last characters of a chunk begin the next
        part = np.frombuffer(text[k : k + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.concatenate([held, np.where((part < 65) | ((part > 90) & (part < 97)) | ((part > 122) & (part < 192)), np.uint32(32), part)])
        for n in NGRAMS:
            # n-grams that end in the new part
            m = len(points) - n + 1
            first = max(0, len(held) - n + 1)
            if m <= first:
                continue
            h = np.full(m - first, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for j in range(n):
                h = (h ^ points[first + j : m + j]) * np.uint32(0x01000193)
            blank = points[first : m] == 32
            if n > 1:
                keep = ~(blank & (points[first + 1 : m + 1] == 32))  # gaps count once
                h = h[keep]
            else:
                h = h[~blank]
            total += np.bincount((h ^ (h >> np.uint32(15))) % np.uint32(DIMENSIONS), minlength=DIMENSIONS)
        held = points[-2:]
    return total


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of counts."""
    x = np.log1p(tf) * idf
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def length_class(grams: np.ndarray | float) -> np.ndarray:
    return np.searchsorted(LENGTHS, grams, side="right")


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # a unit row each
    languages: list[str]  # of each row of centroids
    floors: np.ndarray  # cosine under which a text is rejected, by row and length class

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        return weighted(tf, self.idf)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text."""
        out = []
        for text in texts:
            if text is None or not self.languages or not _LETTER.search(text):
                out.append((UNKNOWN, 0.0, True))
                continue
            tf = counts(text)
            near = self.centroids @ self.vectors(tf).astype(np.float32)
            best = int(np.argmax(near))
            floor = self.floors[best, length_class(tf.sum())]
            out.append((self.languages[best], float(min(1.0, max(0.0, near[best]))), bool(near[best] < floor)))
        return out


UNTAUGHT = Model(np.zeros(DIMENSIONS), np.zeros((0, DIMENSIONS), np.float32), [], np.zeros((0, len(LENGTHS) + 1)))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids of unit rows; starts from rows far from one another."""
    chosen = [0]
    for _ in range(1, min(k, len(x))):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    c = x[chosen].copy()
    for _ in range(rounds):
        to = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (to == j).any():
                m = x[to == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def floors_of(grams: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """By length class, the cosine under which a text is rejected; it never falls with length."""
    out, least = [], SHORT_SHARE * float(np.quantile(cosines, 0.01))
    for k in range(len(LENGTHS) + 1):
        own = cosines[length_class(grams) == k]
        if k and len(own) >= LEAST_TEXTS:
            least = max(least, REJECT_SHARE * float(np.quantile(own, 0.01)))
        out.append(least)
    return np.array(out)


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Learn from documents that aren't held out, by their text and language alone.

    First pass: labels are counted, no text is read. Second: somewhat over
    per_language texts of each language are picked by hash; the executors make
    them sparse counts, and those with the least hashes are kept. From these come
    document frequencies (a row a dimension) and, a task a language, its centroids.
    """
    usable = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    sizes = usable.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} different labels")
    if not sizes:
        return UNTAUGHT
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, (1.25 * per_language + 40) / r["count"]))])
    u = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    picked = usable.withColumn("u", u).filter((F.col("u") < share[F.col("lang")] * (1 << 30)) & F.col("text").rlike(r"\p{L}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sparse = [(np.nonzero(tf)[0].astype(np.uint16), tf[tf > 0].astype(np.float32)) for tf in (counts(t.as_py()) for t in batch.column(2))]
            arrays = [batch.column(0), batch.column(1), *(pa.array([x[k].tobytes() for x in sparse], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "u", "dims", "tf"])

    first = Window.partitionBy("lang").orderBy("u", "tf", "dims")
    sparse = picked.select("lang", "u", "text").mapInArrow(run, "lang string, u long, dims binary, tf binary")
    taught = durable(sparse.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_language))
    n = taught.count()
    if not n:
        return UNTAUGHT

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for dims in batch.column(0).to_pylist():
                seen[np.frombuffer(dims, np.uint16)] += 1
        held = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], names=["dim", "n"])

    seen = np.zeros(DIMENSIONS)
    for r in taught.select("dims").mapInArrow(occurring, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        seen[r.dim] = r.n
    idf = np.log((1 + n) / (1 + seen)) + 0.1

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        own = np.zeros((len(pdf), DIMENSIONS), np.float32)
        for k, (dims, tf) in enumerate(zip(pdf["dims"], pdf["tf"], strict=True)):
            own[k, np.frombuffer(dims, np.uint16)] = np.frombuffer(tf, np.float32)
        grams = own.sum(axis=1, dtype=np.float64)
        own = weighted(own, idf).astype(np.float32)
        c = spherical_kmeans(own, centroids)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "centroids": [c.astype(np.float32).tobytes()], "grams": [grams.tolist()], "cosines": [(own @ c.T).max(axis=1).astype(float).tolist()]})

    found = sorted(taught.groupBy("lang").applyInPandas(cluster, "lang string, centroids binary, grams array<double>, cosines array<double>").collect(), key=lambda r: r.lang)
    every = floors_of(np.array([g for r in found for g in r.grams]), np.array([c for r in found for c in r.cosines]))
    model = Model(idf, np.zeros((0, DIMENSIONS), np.float32), [], UNTAUGHT.floors)
    rows, floors = [], []
    for r in found:
        c = np.frombuffer(r.centroids, np.float32).reshape(-1, DIMENSIONS)
        rows.append(c)
        model.languages += [r.lang] * len(c)
        # a language that is less like itself than others are has its own floors
        floors += [np.minimum(every, floors_of(np.array(r.grams), np.array(r.cosines)))] * len(c)
    model.centroids, model.floors = np.concatenate(rows), np.array(floors)
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row; with keep, a struct `row` of all columns as well. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for k in range(0, batch.num_rows, 64) for p in model.predict(batch.column(1).slice(k, 64).to_pylist())]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            more = [batch.column(2)] if keep else []
            arrays = [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), *more]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score", "rejected", *["row"] * keep])

    schema = f"doc_id {kind}, lang_pred string, score double, rejected boolean" + f", row {docs.schema.simpleString()}" * keep
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.struct("*").alias("row")] * keep]
    return docs.select(*columns).mapInArrow(run, schema)


def identify_all(docs: DataFrame, **columns) -> DataFrame:
    """Fit on the documents that may be learned from, then predict all."""
    return identify(docs, fit(docs, **columns))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of documents whose language isn't rejected, all columns as they were."""
    found = identify(docs, fit(docs), keep=True)
    return found.filter(~F.col("rejected")).select("row.*")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    found = identify_all(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
