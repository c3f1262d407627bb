"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the mean of the hashed embeddings of itself, its openings and its endings. Filters of
several widths run over a text's words, the greatest value of each filter anywhere in the text
(max pooling) goes to a logistic layer. Whole texts are read, in batches and without a shuffle.

Training: all labelled texts that aren't held out, whole. Up to FIRST of them are one task's: beside the model of
all, FOLDS models that leave a fold out are trained, each in a task of its own. More are dealt to a first part and others of about PART. The
first is learned from in that way; from its network, and from how far its steps have shrunk, every other part goes on through its own
texts once, and what they come to is averaged, in two levels so that no task holds many networks. A part belongs to a fold: the
average without a fold's parts has not seen its texts. From what these models say about the texts they
left out, counted by score, a threshold for each language is calibrated (best F1). The language is told from the text's own function
words, never from a column. A score is shifted so that its language's threshold becomes CUT.

Null and empty texts are scored as an empty text. Rows with a null id or label are never learned
from; of labels that contradict each other, toxic counts. Repeated rows are scored alike; of equal
language hits the first language by name holds; extra columns are ignored. Without labels of both kinds,
every score is the share of toxic ones (0 without any). An empty table gives an empty result.
"""

from __future__ import annotations

import copy
import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

#: From this score on a text is called toxic.
CUT = 0.3
BUCKETS = 1 << 17
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 16
OPENINGS, ENDINGS = (3, 4, 5, 6), (3, 4)
PIECES = 1 + len(OPENINGS) + len(ENDINGS)
BATCH, RATE, DECAY = 32, 0.08, 1e-4
#: Passes over the training texts: as many as make STEPS steps, within these bounds.
STEPS, LEAST_EPOCHS, MOST_EPOCHS = 400, 6, 16
#: Training texts that a piece of a word must occur in; others say nothing. Share of words that a training step leaves out.
LEAST_DOCS = 3
DROPPED = 0.4
FOLDS = 3
#: Texts that one task learns from in several passes, about; of more, those of a part, which is gone through once in STEPS steps.
FIRST, PART = 4000, STEPS * BATCH
#: Networks that one task adds up, about; parts of a unit that scores are counted in.
ADDED, SCORE_BINS = 16, 10_000
#: Texts of either label that a language's own threshold needs in training.
LEAST_TEXTS = 8
#: Words of a block of texts that is scored at a time (a longer text is a block of its own).
BLOCK_WORDS = 1 << 17
#: Bits that a label's id gets in the table that spares most documents without one the shuffle; all bits at most (16 MB).
ID_BITS, MOST_BITS = 16, 1 << 27

#: Function words that tell languages apart.
FUNCTION_WORDS = {
    "de": "der die das den dem des ein eine einen und ist nicht mit von zu auf sich auch für im",
    "en": "the of and to in is was that it for on as with be at by this had not are from",
    "es": "el la los las de y que en un una es por con para del se al como su más",
    "fr": "le la les de des et est un une que dans en du pour pas sur au qui par ce",
}
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}+")
#: Latin-1 with a space for each character that is no letter.
_LETTERS = bytes(k if _WORD.fullmatch(chr(k)) else 32 for k in range(256))


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case. A text of Latin-1 letters is split at its other characters, which costs less than a pattern."""
    low = (text or "").lower()
    try:
        return low.encode("latin-1").translate(_LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(low)


#: A step of CRC-32 for each value of a byte.
_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _STEP = np.where(_STEP & 1, (_STEP >> 1) ^ np.uint32(0xEDB88320), _STEP >> 1)
_ALL = np.uint32(0xFFFFFFFF)


def _crc(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, start: np.ndarray) -> np.ndarray:
    """zlib.crc32 of raw[begin:end], continued from start, of many stretches at once: a byte of all of them at a time."""
    out, live = start ^ _ALL, np.flatnonzero(begin < end)
    at, last, state = begin[live], end[live], out[live]
    while len(live):
        state = _STEP[(state ^ raw[at]) & 255] ^ (state >> 8)
        at = at + 1
        more = at < last
        if not more.all():
            out[live[~more]] = state[~more]
            live, at, last, state = live[more], at[more], last[more], state[more]
    return out ^ _ALL


def pieces_of(words: list[str]) -> np.ndarray:
    """A row a word: buckets of it and its openings and endings; BUCKETS, an embedding of zeros, where it is too short."""
    raw = np.frombuffer("".join(words).encode("utf-8", "surrogatepass"), np.uint8)
    place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # of code points
    size = np.fromiter(map(len, words), np.int64, len(words))
    last = np.cumsum(size)
    first = last - size
    out = np.full((len(words), PIECES), BUCKETS, np.int32)
    out[:, 0] = _crc(raw, place[first], place[last], np.zeros(len(words), np.uint32)) % BUCKETS
    begun, done = np.full(len(words), zlib.crc32(b"^"), np.uint32), 0
    for k, n in enumerate(OPENINGS, 1):  # each goes on from the one before
        rows = np.flatnonzero(size >= n)
        begun[rows] = _crc(raw, place[first[rows] + done], place[first[rows] + n], begun[rows])
        out[rows, k], done = begun[rows] % BUCKETS, n
    for k, n in enumerate(ENDINGS, 1 + len(OPENINGS)):
        rows = np.flatnonzero(size >= n)
        out[rows, k] = _crc(raw, place[last[rows] - n], place[last[rows]], np.full(len(rows), zlib.crc32(b"$"), np.uint32)) % BUCKETS
    return out


def pieces(word: str) -> list[int]:
    """pieces_of() of one word."""
    return pieces_of([word])[0].tolist()


class Language:
    """The language whose function words a text has most of."""

    def __init__(self, words: dict[str, str] = FUNCTION_WORDS):
        self.names = sorted(words)
        self.of: dict[str, np.ndarray] = {}
        for k, name in enumerate(self.names):
            for w in words[name].split():
                self.of.setdefault(w, np.zeros(len(self.names), np.int64))[k] = 1

    def hits(self, words: list[str]) -> np.ndarray:
        """A row a word, a column a language."""
        out = np.zeros((len(words), len(self.names)), np.int64)
        for i in [i for i, w in enumerate(words) if w in self.of]:
            out[i] = self.of[words[i]]
        return out

    def of_texts(self, texts: Texts) -> list[str]:
        """name() of each text."""
        if not len(texts.start):
            return []
        hits = np.concatenate([np.zeros((1, len(self.names)), np.int64), self.hits(texts.words)])
        bounds = np.stack([texts.start, texts.start + texts.size], axis=1).ravel()
        return [self.name(h) for h in np.add.reduceat(hits[texts.ids], bounds, axis=0)[::2]]

    def name(self, hits: np.ndarray) -> str:
        return self.names[int(np.argmax(hits))] if hits.any() else UNKNOWN

    def tell(self, text: str | None) -> str:
        return self.name(self.hits([w for w in words_of(text) if w in self.of]).sum(axis=0))


class Texts:
    """Texts as places in a table of distinct words, each followed by enough blanks for the widest filter."""

    def __init__(self, texts: Iterable[list[str]]):
        known: defaultdict[str, int] = defaultdict(count(1).__next__)
        pad = max(WIDTHS) - 1
        ids: list[np.ndarray] = []  # of words, without blanks
        held: list[str] = []
        sizes = []

        def number() -> None:
            codes, distinct = pd.factorize(np.array(held, object))
            ids.append(np.fromiter(map(known.__getitem__, distinct), np.int32, len(distinct))[codes])
            held.clear()

        for words in texts:
            sizes.append(len(words))
            held += words
            if len(held) > BLOCK_WORDS:
                number()
        number()
        many = np.array(sizes, np.int64)
        self.words = list(known)
        self.size = np.maximum(many, 1)
        self.start = np.cumsum(self.size + pad) - self.size - pad
        self.ids = np.zeros(int((self.size + pad).sum()) + pad, np.int32)
        self.ids[np.repeat(self.start - np.cumsum(many) + many, many) + np.arange(many.sum())] = np.concatenate(ids)
        self.pieces = np.full((len(known) + 1, PIECES), BUCKETS, np.int32)
        if known:
            self.pieces[1:] = pieces_of(self.words)
        self.weight = 1 / np.maximum((self.pieces != BUCKETS).sum(axis=1), 1).astype(np.float32)


@dataclass
class Network:
    embedding: np.ndarray  # BUCKETS + 1 rows; the last one is zero
    filters: list[np.ndarray]  # of each width: (width, DIMENSIONS, FILTERS)
    bias: np.ndarray  # a filter each, widths in order
    out: np.ndarray
    base: float
    seen: tuple | None = None  # of training that may go on

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        draw = np.random.default_rng(seed)
        embedding = draw.normal(0, 0.3, (BUCKETS + 1, DIMENSIONS)).astype(np.float32)
        embedding[-1] = 0
        filters = [draw.normal(0, (w * DIMENSIONS) ** -0.5, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        many = FILTERS * len(WIDTHS)
        return cls(embedding, filters, np.zeros(many, np.float32), draw.normal(0, many**-0.5, many).astype(np.float32), 0.0)

    def vectors(self, texts: Texts, words=slice(None)) -> np.ndarray:
        rows = texts.pieces[words]
        out = self.embedding[rows[:, 0]]
        for k in range(1, PIECES):
            out += self.embedding[rows[:, k]]
        return out * texts.weight[words, None]

    def scores(self, texts: Texts) -> np.ndarray:
        """Probability of each text. Each distinct word meets each part of a filter once; texts add these up."""
        v = self.vectors(texts)
        pooled = np.empty((len(texts.start), FILTERS * len(WIDTHS)), np.float32)
        bounds = np.stack([texts.start, texts.start + texts.size], axis=1).ravel()
        for j, part in enumerate(self.filters):
            value = (v @ part[0])[texts.ids]
            for k in range(1, len(part)):
                value[:-k] += (v @ part[k])[texts.ids[k:]]
            if len(bounds):
                pooled[:, j * FILTERS : (j + 1) * FILTERS] = np.maximum.reduceat(value, bounds, axis=0)[::2]
        return _sigmoid((np.maximum(pooled + self.bias, 0).astype(np.float64) * self.out).sum(axis=1) + self.base)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adagrad:
    """Steps that shrink with the squares of what a parameter has seen."""

    def __init__(self, shape):
        self.seen = np.full(shape, 1e-6, np.float32)

    def step(self, value: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        self.seen[rows] += grad * grad
        value[rows] -= RATE * grad / np.sqrt(self.seen[rows])


def texts_with(texts: Texts, chosen: Iterable[int]) -> np.ndarray:
    """How many of the chosen texts hold each bucket."""
    docs, last = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    for i in chosen:
        own = texts.pieces[texts.ids[texts.start[i] : texts.start[i] + texts.size[i]]].ravel()
        at = np.arange(len(own))
        last[own] = at  # one place of each bucket
        docs[own[last[own] == at]] += 1
    return docs


def rare_pieces(texts: Texts, chosen: np.ndarray) -> np.ndarray:
    """Buckets that fewer than LEAST_DOCS of the chosen texts hold, and that of the blank."""
    docs = texts_with(texts, chosen)
    docs[BUCKETS] = 0
    return np.nonzero(docs < LEAST_DOCS)[0]


def train(texts: Texts, labels: np.ndarray, chosen: np.ndarray, seed: int = 0, epochs: int | None = None, rare: np.ndarray | None = None, toxic: float | None = None, start: Network | None = None) -> Network:
    """Logistic loss over the chosen texts, by Adagrad in small batches; the two labels weigh the same.

    rare (buckets that say nothing) and toxic (the share of that label) are those of the chosen texts, or given: those of all parts. From start training goes on where it ended.
    """
    epochs = epochs or int(np.clip(STEPS * BATCH // max(len(chosen), 1), LEAST_EPOCHS, MOST_EPOCHS))
    net = copy.deepcopy(start) if start else Network.fresh(seed)
    net.embedding[rare_pieces(texts, chosen) if rare is None else rare] = 0
    frozen = ~net.embedding.any(axis=1)
    draw = np.random.default_rng(seed)
    share = np.array([(labels[chosen] == c).mean() for c in (0, 1)]) if toxic is None else np.array([1 - toxic, toxic])
    weight = np.where(labels == 1, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9)).astype(np.float32)
    fresh = (Adagrad(net.embedding.shape), [Adagrad(f.shape) for f in net.filters], Adagrad(net.bias.shape), Adagrad(net.out.shape), 1e-6)
    seen_embedding, seen_filters, seen_bias, seen_out, base_seen = net.seen or fresh
    for _ in range(epochs):
        order = draw.permutation(chosen)
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            spans = [np.arange(texts.start[i], texts.start[i] + texts.size[i] + max(WIDTHS) - 1) for i in own]
            places = texts.ids[np.concatenate(spans)]
            ids, inverse = np.unique(np.where(draw.random(len(places)) < DROPPED, 0, places), return_inverse=True)
            v = net.vectors(texts, ids)
            starts = np.cumsum([0] + [len(s) for s in spans])[:-1]
            best = np.empty((len(own), len(net.bias)), np.int64)
            pooled = np.empty((len(own), len(net.bias)), np.float32)
            for j, part in enumerate(net.filters):
                value = (v @ part[0])[inverse]
                for t in range(1, len(part)):
                    value[:-t] += (v @ part[t])[inverse[t:]]
                at = slice(j * FILTERS, (j + 1) * FILTERS)
                for i, (s, doc) in enumerate(zip(starts, own, strict=True)):
                    window = value[s : s + texts.size[doc]]
                    top = window.argmax(axis=0)
                    best[i, at], pooled[i, at] = s + top, window[top, np.arange(FILTERS)]
            hidden = np.maximum(pooled + net.bias, 0)
            p = _sigmoid(hidden @ net.out + net.base)
            slope = ((p - labels[own]) * weight[own] / len(own)).astype(np.float32)
            back = slope[:, None] * net.out * (hidden > 0)
            g_out, g_base = hidden.T @ slope + DECAY * net.out, float(slope.sum())
            touched: list[np.ndarray] = []
            moved: list[np.ndarray] = []
            for j, part in enumerate(net.filters):
                at = slice(j * FILTERS, (j + 1) * FILTERS)
                g_part = np.empty_like(part)
                for t in range(len(part)):
                    word = inverse[best[:, at] + t]  # (text, filter)
                    g_part[t] = np.einsum("dfe,df->ef", v[word], back[:, at])
                    touched.append(word.ravel())
                    moved.append((back[:, at, None] * part[t].T[None]).reshape(-1, DIMENSIONS))
                seen_filters[j].step(part, g_part)
            word, grad = np.concatenate(touched), np.concatenate(moved)
            live = np.abs(grad).max(axis=1) > 0
            word, grad = word[live], grad[live]
            if len(word):
                rows = texts.pieces[ids[word]]
                piece, which = np.unique(rows, return_inverse=True)
                share_of = np.repeat(grad * texts.weight[ids[word], None], PIECES, axis=0)
                total = np.stack([np.bincount(which.ravel(), share_of[:, d], len(piece)) for d in range(DIMENSIONS)], axis=1).astype(np.float32)
                real = ~frozen[piece]
                seen_embedding.step(net.embedding, total[real], piece[real])
            seen_bias.step(net.bias, back.sum(axis=0))
            seen_out.step(net.out, g_out)
            base_seen += g_base * g_base
            net.base -= RATE * g_base / base_seen**0.5
    net.seen = seen_embedding, seen_filters, seen_bias, seen_out, base_seen
    return net


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The cut with the best F1 of weighted texts, midway between the scores it parts; the highest of equally good ones."""
    order = np.argsort(-scores, kind="stable")
    s, y, w = scores[order], labels[order], weights[order]
    right, called = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * right / (called + (w * y).sum())
    last = np.append(s[1:] != s[:-1], True)
    at = int(np.argmax(np.where(last, f1, -1)))
    below = s[at + 1] if at + 1 < len(s) else 0.0
    return float(np.clip((s[at] + below) / 2, 0.01, 0.99))


@dataclass
class Model:
    network: Network | None
    thresholds: dict[str, float]  # by language; UNKNOWN holds for all others
    share: float  # of toxic labels: the score where there is no network

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """A score of each text; the words of a block of texts are held at a time."""
        if self.network is None:
            return np.array([self.share for _ in texts])
        out = [self._of_block(block) for block in blocks(texts)]
        return np.clip(np.concatenate([np.zeros(0), *out]), 0, 1).round(6)  # sums of products differ in their last digits with the block

    def _of_block(self, words: list[list[str]]) -> np.ndarray:
        block, out = Texts(words), np.zeros(len(words))
        for i, (p, name) in enumerate(zip(self.network.scores(block), Language().of_texts(block), strict=True)):
            cut = self.thresholds.get(name, self.thresholds[UNKNOWN])
            out[i] = CUT * p / cut if p < cut else CUT + (1 - CUT) * (p - cut) / (1 - cut)
        return out


def blocks(texts: Iterable[str | None]) -> Iterator[list[list[str]]]:
    """The words of texts, BLOCK_WORDS at a time or one longer text."""
    held, total = [], 0
    for t in texts:
        words = words_of(t)
        if held and total + len(words) > BLOCK_WORDS:
            yield held
            held, total = [], 0
        held.append(words)
        total += len(words)
    if held:
        yield held


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", epochs: int | None = None) -> Model:
    """Learn from the labels (id_col, label_col) of documents that aren't held out, and from their texts alone."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(~held_out(F.col("doc_id")) & F.col("label").isin(0, 1))
    one = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    if len(counts) < 2:
        return Model(None, {UNKNOWN: CUT}, share)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    total = sum(counts.values())
    sample = stored(_with_bit(texts, one, total).join(one, "doc_id").dropDuplicates(["doc_id"]))
    if total > FIRST:
        return _fit_parts(sample, share, total, epochs)
    learned = _fit_one(sample, epochs)
    return Model(learned[0], thresholds_of(*learned[1:], share), share) if learned else Model(None, {UNKNOWN: CUT}, share)


def _with_bit(texts: DataFrame, one: DataFrame, total: int) -> DataFrame:
    """The texts whose id may be among those of one (total rows): all that are, and few others. Those alone need be shuffled to meet their label."""
    if texts.schema["doc_id"].dataType != one.schema["doc_id"].dataType:
        return texts
    bits = min(total * ID_BITS, MOST_BITS)
    bit = F.pmod(F.xxhash64("doc_id", F.lit(16)), F.lit(bits)) + 1  # buckets count from 1
    held = one.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    at = F.bitmap_bit_position(bit).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = texts.withColumn("bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(held), "bucket")
    return met.filter(F.getbit(byte, at % 8) == 1).select(*texts.columns)


def _fit_one(sample: DataFrame, epochs: int | None, rare: np.ndarray | None = None, toxic: float | None = None) -> tuple | None:
    """(network, scores, labels, languages) of the texts (doc_id, text, label) of one task: what models that left a text out say of it. None without texts.

    With rare and toxic, those of all parts, training can go on from the network.
    """
    # model FOLDS learns from all, the others leave their part out and judge it
    fold = F.pmod(F.xxhash64("doc_id", F.lit(14)), F.lit(FOLDS)).cast("int")
    tasks = sample.withColumn("fold", fold).withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
    held = sample.sparkSession.sparkContext.broadcast((rare, toxic))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        model, y = int(pdf["model"].iloc[0]), pdf["label"].to_numpy(np.float32)
        own = Texts(words_of(t) for t in pdf["text"])
        chosen = np.nonzero(pdf["fold"].to_numpy() != model)[0]
        net = train(own, y, chosen, epochs=epochs, rare=held.value[0], toxic=held.value[1])
        none = np.zeros(0)
        if model == FOLDS:
            if held.value[0] is None:
                used = np.zeros(BUCKETS + 1, bool)
                used[own.pieces[1:]] = True
                net.embedding[~used], net.seen = 0, None  # what was never learned from says nothing
            return pd.DataFrame({"model": [model], "network": [pickle.dumps(net)], "scores": [none], "labels": [none], "langs": [[]]})
        left = np.nonzero(pdf["fold"].to_numpy() == model)[0]
        language = Language()
        langs = [language.tell(pdf["text"].iloc[i]) for i in left]
        return pd.DataFrame({"model": [model], "network": [b""], "scores": [net.scores(own)[left]], "labels": [y[left].astype(float)], "langs": [langs]})

    schema = "model int, network binary, scores array<double>, labels array<double>, langs array<string>"
    # by range: hashes would deal two of these few models to one task
    found = {r["model"]: r for r in tasks.repartitionByRange(FOLDS + 1, "model").groupBy("model").applyInPandas(learn, schema).collect()}
    if not found:
        return None
    net = pickle.loads(found.pop(FOLDS)["network"])
    scores, y = (np.concatenate([np.zeros(0), *(np.array(r[c]) for r in found.values())]) for c in ("scores", "labels"))
    return net, scores, y, np.array([name for r in found.values() for name in r["langs"]], object)


def _fit_parts(sample: DataFrame, share: float, total: int, epochs: int | None) -> Model:
    """fit() where the labelled texts (doc_id, text, label) are more than a task's."""
    parts = max(FOLDS, -(-(total - FIRST) // PART))
    u = lambda seed, n: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n))
    dealt = sample.withColumn("part", F.when(u(15, total) < FIRST, 0).otherwise(1 + u(16, parts)).cast("int"))
    shared = sample.sparkSession.sparkContext.broadcast

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for block in blocks(t.as_py() for t in batch.column(0)):
                docs += texts_with(Texts(block), range(len(block)))
        held = np.nonzero(docs)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(docs[held])], names=["piece", "docs"])

    told = sample.select("text").mapInArrow(count, "piece int, docs long").groupBy("piece").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCS)
    known = np.array([r.piece for r in told.collect()], np.int64)  # BUCKETS rows at most
    rare = shared(np.setdiff1d(np.arange(BUCKETS + 1), known[known != BUCKETS]))

    first = _fit_one(dealt.filter("part = 0").drop("part"), epochs, rare.value, share)
    begun = shared(first[0])
    dealt = dealt.filter("part > 0")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        own, y = Texts(words_of(t) for t in pdf["text"]), pdf["label"].to_numpy(np.float32)
        net = train(own, y, np.arange(len(y)), epochs=1, rare=rare.value, toxic=share, start=begun.value)
        moved = (net.embedding != Network.fresh().embedding).any(axis=1)
        part = int(pdf["part"].iloc[0])
        return _sums(part % FOLDS, part // FOLDS // ADDED, np.where(moved[:, None], net.embedding, 0), moved.astype(np.float32), _rest(net), 1)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        f32 = lambda c: np.sum([np.frombuffer(b, np.float32) for b in pdf[c]], axis=0)
        return _sums(int(pdf["fold"].iloc[0]), 0, f32("embedding"), f32("moved"), np.sum([np.frombuffer(b, np.float64) for b in pdf["rest"]], axis=0), int(pdf["nets"].sum()))

    schema = "fold int, heap int, embedding binary, moved binary, rest binary, nets int"
    nets = dealt.repartitionByRange(parts, "part").groupBy("part").applyInPandas(learn, schema)
    found = nets.groupBy("fold", "heap").applyInPandas(add, schema).groupBy("fold").applyInPandas(add, schema).collect()  # a network a fold
    models = [_average([r for r in found if r.fold != k], rare.value) for k in range(FOLDS)]
    net, others = _average(found, rare.value), shared(models)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language = Language()
        for batch in batches:
            pdf = batch.to_pandas()
            for fold, own in pdf.groupby(pdf["part"] % FOLDS):
                bins, langs = [], []
                for block in map(Texts, blocks(own["text"])):
                    bins.append(np.floor(others.value[fold].scores(block) * SCORE_BINS).astype(np.int32))
                    langs += language.of_texts(block)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bins)), pa.array(own["label"].to_numpy(np.int32)), pa.array(langs, pa.string())], names=["bin", "label", "lang"])

    judged = dealt.select("text", "label", "part").mapInArrow(judge, "bin int, label int, lang string").groupBy("bin", "label", "lang").agg(F.count("*").alias("n")).toPandas()
    counted = ((judged["bin"].to_numpy() + 0.5) / SCORE_BINS, judged["label"].to_numpy(float), judged["lang"].to_numpy(object), judged["n"].to_numpy(float))
    scores, y, langs, texts = (np.concatenate(x) for x in zip((*first[1:], np.ones(len(first[1]))), counted, strict=True))
    return Model(net, thresholds_of(scores, y, langs, share, texts), share)


def _rest(net: Network) -> np.ndarray:
    """What a network has beside its embedding, in one array."""
    return np.concatenate([*(f.ravel() for f in net.filters), net.bias, net.out, [net.base]]).astype(np.float64)


def _sums(fold: int, heap: int, embedding: np.ndarray, moved: np.ndarray, rest: np.ndarray, nets: int) -> pd.DataFrame:
    return pd.DataFrame({"fold": [fold], "heap": [heap], "embedding": [embedding.astype(np.float32).tobytes()], "moved": [moved.astype(np.float32).tobytes()], "rest": [rest.tobytes()], "nets": [nets]})


def _average(rows: list, rare: np.ndarray) -> Network:
    """The mean of networks of a common start, from their sums; an embedding's is over those that moved it, and zero if none did."""
    total = lambda c, kind: np.sum([np.frombuffer(r[c], kind) for r in rows], axis=0)
    net, moved = Network.fresh(), total("moved", np.float32)
    net.embedding = (total("embedding", np.float32).reshape(-1, DIMENSIONS) / np.maximum(moved, 1)[:, None]).astype(np.float32)
    net.embedding[rare] = 0
    rest, at = total("rest", np.float64) / sum(r["nets"] for r in rows), 0
    for k, f in enumerate(net.filters):
        net.filters[k] = rest[at : at + f.size].reshape(f.shape).astype(np.float32)
        at += f.size
    many = len(net.bias)
    net.bias, net.out, net.base = rest[at : at + many].astype(np.float32), rest[at + many : at + 2 * many].astype(np.float32), float(rest[-1])
    return net


def thresholds_of(scores: np.ndarray, labels: np.ndarray, langs: np.ndarray, share: float, texts: np.ndarray | None = None) -> dict[str, float]:
    """Thresholds by language, and of all texts under UNKNOWN. Texts of a label weigh by the label's true share; texts: how many each row stands for."""
    texts = np.ones(len(scores)) if texts is None else texts
    taken = np.array([texts[labels == c].sum() for c in (0, 1)])
    if not taken.all():
        return {UNKNOWN: 0.5}
    weights = texts * np.where(labels == 1, share / taken[1], (1 - share) / taken[0])
    out = {UNKNOWN: best_threshold(scores, labels, weights)}
    for name in sorted(set(langs)):
        own = langs == name
        if name != UNKNOWN and min(texts[own & (labels == c)].sum() for c in (0, 1)) >= LEAST_TEXTS:
            out[name] = best_threshold(scores[own], labels[own], weights[own])
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row. No shuffle; the model, of some megabytes whatever the input, is broadcast."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(t.as_py() for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
