"""Ranking notes for questions: BM25, cosine, fusion, budgets.

Everything is keyed by question, so that one plan answers many questions over
many documents. Texts stay out of ranking; they are joined to the ids that are left.

BM25 statistics (notes, document frequencies, mean length) are over all notes of
all documents; pass per_document=True for statistics within each document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.binding import words_array
from ..lexicons import INTENTS, QUERY_STOP_WORDS
from ..regex import B0, B1, WORD

K1, B = 1.2, 0.75
DEPTH, CANDIDATES, SHOWN = 60, 30, 8
RRF_K, BOTH_BONUS = 60, 1 / 120
FLOOR = 0.56
BUDGET = 18_000
#: Question terms that one plan may hold as a broadcast table.
MOST_TERMS = 100_000

#: Letters and digits of a note, lower case, without diacritics of the Latin-1 and Latin Extended-A letters.
_ACCENTED = "àáâãäåāăąçćčďđèéêëēĕėęěğìíîïĩīłñńňòóôõöøōőŕřśšşťţùúûüũūůűýÿžźż"
_PLAIN = "aaaaaaaaacccddeeeeeeeeegiiiiiilnnnoooooooorrsssttuuuuuuuuyyzzz"


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def question_terms(question: Column) -> Column:
    """Words of a question that search for something: function words and lone letters go, digits stay."""
    found = F.transform(F.regexp_extract_all(F.lower(question), F.lit(WORD), F.lit(0)), lambda t: F.regexp_replace(t, "['’-]+$", ""))
    stop = words_array(QUERY_STOP_WORDS)
    digit = lambda t: t.rlike("[0-9]")
    return F.filter(found, lambda t: ((F.length(t) >= 2) | digit(t)) & (digit(t) | ~F.array_contains(stop, t)))


def expansion_terms(question: Column) -> Column:
    """Terms that the intent rules add, in order, without repeats."""
    added = [F.when(F.regexp_like(question, F.lit(f"(?i){B0}(?:{pattern}){B1}")), words_array(terms)).otherwise(F.array().cast("array<string>")) for pattern, terms in INTENTS]
    return F.array_distinct(F.concat(*added))


def term_table(questions: DataFrame, expand: bool = True) -> DataFrame:
    """question_id, term, phrase (array of tokens), is_prefix: what each question searches for."""
    all_terms = F.concat(question_terms(F.col("question")), expansion_terms(F.col("question"))) if expand else question_terms(F.col("question"))
    rows = questions.select("question_id", F.explode(F.array_distinct(all_terms)).alias("term"))
    rows = rows.select("question_id", "term", tokens(F.col("term")).alias("phrase"), (F.length("term") >= 4).alias("is_prefix"))
    return rows.filter(F.size("phrase") > 0)


def bm25(notes: DataFrame, questions: DataFrame, expand: bool = True, per_document: bool = False, depth: int | None = DEPTH) -> DataFrame:
    """question_id, note_id, doc_id, score (negative, lower is better), rank.

    notes: note_id, doc_id, text. A batch's tokens meet the broadcast terms before anything is
    shuffled, so that only counts of phrases that occur are. Phrases (terms of several tokens) must stand together in order.
    """
    terms = term_table(questions, expand)
    phrases = terms.select("phrase", "is_prefix").distinct()
    if phrases.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} different terms at once")
    toks = notes.select("note_id", "doc_id", tokens(F.col("text")).alias("t")).withColumn("length", F.size("t"))
    sizes = toks.groupBy(*["doc_id"] * per_document).agg(F.count("*").alias("notes"), F.avg("length").alias("mean"))
    counted = _phrase_counts(toks, phrases)
    return _scored(counted, sizes, terms, per_document, depth)


def _phrase_counts(toks: DataFrame, phrases: DataFrame) -> DataFrame:
    """note_id, doc_id, length, phrase, is_prefix, f of the phrases (phrase, is_prefix) that notes (note_id, doc_id, t) hold.

    Each different token of a batch is compared with the phrases' tokens once, whole or by its opening.
    """
    spark = toks.sparkSession
    sought = [(list(r.phrase), r.is_prefix) for r in phrases.collect()]  # MOST_TERMS phrases at most
    wishes: dict[tuple[str, bool], int] = {}
    told = [[wishes.setdefault((w, p and k == len(phrase) - 1), len(wishes)) for k, w in enumerate(phrase)] for phrase, p in sought]
    whole = {w: j for (w, by_opening), j in wishes.items() if not by_opening}
    openings = {w: j for (w, by_opening), j in wishes.items() if by_opening}
    lone = np.full(len(wishes) + 1, -1, np.int64)  # the phrase that a token is by itself
    several: dict[int, list[int]] = {}  # phrases of several tokens by the first
    for k, own in enumerate(told):
        if len(own) == 1:
            lone[own[0]] = k
        else:
            several.setdefault(own[0], []).append(k)
    kinds = {c: toks.schema[c].dataType.simpleString() for c in ("note_id", "doc_id")}
    shared = spark.sparkContext.broadcast((told, whole, openings, sorted({len(w) for w in openings}), lone, several))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, whole, openings, lengths, lone, several = shared.value
        for all_notes in batches:
            for batch in _by_tokens(all_notes):
                own = batch.column(2)
                sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                words = own.flatten().dictionary_encode()
                fits = []  # (token, wish) of different tokens
                for c, w in enumerate(words.dictionary.to_pylist()):
                    if w in whole:
                        fits.append((c, whole[w]))
                    for n in lengths:
                        if len(w) >= n and w[:n] in openings:
                            fits.append((c, openings[w[:n]]))
                if not fits:
                    continue
                token, wish = np.array(fits, np.int64).T
                start = np.searchsorted(token, np.arange(len(words.dictionary) + 1))
                code, row = words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
                at = np.nonzero(start[code + 1] > start[code])[0]
                many = start[code[at] + 1] - start[code[at]]
                place = np.repeat(at, many)
                fit = wish[np.repeat(start[code[at]], many) + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)]
                alone = lone[fit] >= 0
                found = [(row[place[alone]], lone[fit[alone]])]
                if several:
                    order = np.argsort(fit, kind="stable")
                    ends = np.searchsorted(fit[order], np.arange(len(lone)))
                    places = lambda j: place[order[ends[j] : ends[j + 1]]]  # noqa: B023, E731
                    for first in several.keys() & set(fit.tolist()):
                        for k in several[first]:
                            here = places(first)
                            here = here[here + len(told[k]) <= len(row)]
                            here = here[row[here] == row[here + len(told[k]) - 1]]
                            for n, j in enumerate(told[k][1:], 1):
                                here = here[np.isin(here + n, places(j))]
                            found.append((row[here], np.full(len(here), k)))
                rows, phrase = (np.concatenate(x) for x in zip(*found, strict=True))
                key, f = np.unique(rows * len(told) + phrase, return_counts=True)
                at = pa.array(key // len(told))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sizes[key // len(told)], pa.int32()), pa.array(key % len(told), pa.int32()), pa.array(f, pa.int64())], names=["note_id", "doc_id", "length", "k", "f"])

    met = toks.select("note_id", "doc_id", "t").mapInArrow(run, f"note_id {kinds['note_id']}, doc_id {kinds['doc_id']}, length int, k int, f long")
    counted = met.groupBy("note_id", "doc_id", "length", "k").agg(F.sum("f").alias("f"))
    names = spark.createDataFrame([(k, *s) for k, s in enumerate(sought)], "k int, phrase array<string>, is_prefix boolean")
    return counted.join(F.broadcast(names), "k").drop("k")


def _scored(counted: DataFrame, sizes: DataFrame, terms: DataFrame, per_document: bool, depth: int | None) -> DataFrame:
    """The ranking from counted (note_id, doc_id, length, phrase, is_prefix, f) and sizes (notes, mean)."""
    scope = ["doc_id"] if per_document else []
    # f is named, so that both uses of counted have one plan and it is computed once
    df = counted.groupBy("phrase", "is_prefix", *scope).agg(F.count_if(F.col("f") > 0).alias("n"))
    # a row a phrase: of counted size unless it is by document
    hits = counted.join(df if scope else F.broadcast(df), ["phrase", "is_prefix", *scope])
    hits = hits.join(sizes, scope) if scope else hits.crossJoin(F.broadcast(sizes))
    idf = F.greatest(F.log((F.col("notes") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hits.select("note_id", "doc_id", "phrase", "is_prefix", part.alias("part"))
    per = scored.join(F.broadcast(terms), ["phrase", "is_prefix"]).groupBy("question_id", "note_id", "doc_id").agg((-F.sum("part")).alias("score"))
    # parts are summed in any order: ties are by the rounded score
    return ranked(per, F.round("score", 9), F.col("note_id"), depth=depth)


#: Parts that postings are clustered in, by a token's first letter; terms of which each token is sought by its own range.
SLOTS = 37
MOST_RANGES = 200


def slot_of(token: Column) -> Column:
    """The part of the index that holds a token: known from its first letter, so for openings of any length as well."""
    return F.pmod(F.ascii(token), F.lit(SLOTS)).cast("int")


def postings(notes: DataFrame) -> DataFrame:
    """slot, token, note_id, doc_id, length, positions: the index that bm25_indexed() reads, made once when notes are stored.

    A note's tokens meet within its row, so that nothing is shuffled but what clustered() deals.
    """
    toks = notes.select("note_id", "doc_id", tokens(F.col("text")).alias("t"))
    kinds = {c: notes.schema[c].dataType.simpleString() for c in ("note_id", "doc_id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_tokens(whole):
                own = batch.column(2)
                sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                if not sizes.sum():
                    continue
                words = own.flatten().dictionary_encode()
                code, row = words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                key = row * len(words.dictionary) + code
                order = np.argsort(key, kind="stable")  # positions stay in order
                first = np.nonzero(np.diff(key[order], prepend=-1))[0]
                head = order[first]
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(pos[order], pa.int32()))
                at = pa.array(row[head])
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[head])), batch.column(0).take(at), batch.column(1).take(at), pa.array(sizes[row[head]], pa.int32()), places], names=["token", "note_id", "doc_id", "length", "positions"])

    grouped = toks.mapInArrow(run, f"token string, note_id {kinds['note_id']}, doc_id {kinds['doc_id']}, length int, positions array<int>")
    return grouped.withColumn("slot", slot_of(F.col("token")))


#: Tokens that postings are made of at a time, or one longer note.
TOKENS_AT_ONCE = 1 << 19


def _by_tokens(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > TOKENS_AT_ONCE:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def clustered(index: DataFrame, order: Sequence[str] = ("slot", "token", "doc_id", "note_id")) -> DataFrame:
    """postings dealt and sorted by slot and token, to be written by slot: a file holds a stretch of tokens, and a
    frequent token's postings may be split between files.
    """
    return index.repartitionByRange(*order).sortWithinPartitions(*order)


def note_sizes(notes: DataFrame) -> DataFrame:
    """doc_id, notes, length: what BM25 must know of the notes that hold no term, a row a document."""
    return notes.groupBy("doc_id").agg(F.count("*").alias("notes"), F.sum(F.col("tokens").cast("long")).alias("length"))


def of_terms(index: DataFrame, wanted: list) -> DataFrame:
    """The part of clustered postings that may hold any of the wanted (want, open): whole slots are left
    unread, and within a slot the stretches of tokens that the files' statistics rule out.
    """
    first = sorted({ord(w.want[0]) % SLOTS for w in wanted})
    part = index.filter(F.col("slot").isin(first)) if "slot" in index.columns else index
    if len(wanted) > MOST_RANGES:
        return part
    hit = F.lit(False)
    for w in sorted({(w.want, w.open) for w in wanted}):
        hit = hit | (F.startswith("token", F.lit(w[0])) if w[1] else F.col("token") == w[0])
    return part.filter(hit)


def bm25_indexed(index: DataFrame, sizes: DataFrame, questions: DataFrame, expand: bool = True, per_document: bool = False, depth: int | None = DEPTH) -> DataFrame:
    """bm25() from postings and note_sizes() (doc_id, notes, length): no text is read, and of the index what the terms need.

    The terms' tokens, a broadcast, meet postings in one pass by their openings; the tokens of
    a phrase then meet by note, where their places must follow one another.
    """
    terms = term_table(questions, expand)
    phrases = terms.select("phrase", "is_prefix").distinct()
    if phrases.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} different terms at once")
    total = [F.sum("notes").alias("notes"), (F.sum("length") / F.sum("notes")).alias("mean")]
    sizes = sizes.groupBy("doc_id").agg(*total) if per_document else sizes.agg(*total)
    wanted = phrases.select("phrase", "is_prefix", F.posexplode("phrase").alias("k", "want"))
    wanted = wanted.withColumn("open", F.col("is_prefix") & (F.col("k") == F.size("phrase") - 1)).withColumn("shared", F.least(F.length("want"), F.lit(4)))
    known = wanted.select("want", "open", "shared").distinct().collect()  # MOST_TERMS phrases at most
    opening = lambda c, n: F.struct(F.lit(n).alias("n") if isinstance(n, int) else n.alias("n"), F.substring(c, F.lit(1), F.lit(n) if isinstance(n, int) else n).alias("letters"))
    openings = F.array(*[opening("token", n) for n in sorted({w.shared for w in known})]) if known else F.array().cast("array<struct<n:int,letters:string>>")
    rows = of_terms(index, known).select("token", "note_id", "doc_id", "length", "positions", F.explode(openings).alias("o"))
    fits = F.when(F.col("open"), F.startswith("token", "want")).otherwise(F.col("token") == F.col("want"))
    keyed = wanted.withColumn("o", opening("want", F.col("shared")))
    met = rows.join(F.broadcast(keyed), "o").filter(fits)
    met = met.select("note_id", "doc_id", "length", "phrase", "is_prefix", "k", F.transform("positions", lambda p: p - F.col("k")).alias("starts"))
    by_token = met.groupBy("note_id", "doc_id", "length", "phrase", "is_prefix", "k").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    whole = by_token.groupBy("note_id", "doc_id", "length", "phrase", "is_prefix").agg(F.collect_list("starts").alias("s")).filter(F.size("s") == F.size("phrase"))
    counted = whole.withColumn("f", F.size(F.aggregate(F.slice("s", 2, 1000), F.get("s", F.lit(0)), lambda a, x: F.array_intersect(a, x))).cast("long")).drop("s").filter("f > 0")
    return _scored(counted, sizes, terms, per_document, depth)


def ranked(rows: DataFrame, *order: Column, by=("question_id",), depth: int | None = None) -> DataFrame:
    """rows with their rank from 1 within `by`; rows beyond depth go (a partial top-k runs before the shuffle)."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if depth is None else out.filter(F.col("rank") <= depth)


def cosine_ranking(vectors: DataFrame, questions: DataFrame, depth: int = DEPTH) -> DataFrame:
    """question_id, note_id, score, rank by cosine of unit vectors: vectors (note_id, v), questions (question_id, q).

    Each batch of vectors is one matrix and meets the questions, a broadcast, in one product;
    it leaves the best `depth` of each question, ties by note, so that at most these are shuffled. More questions than
    MOST_QUESTIONS take several passes, so that driver and tasks hold one pass's questions at a time. Vectors of another width
    than the questions' are an error that says so, as are questions of several widths.
    """
    asked = questions.select("question_id", "q")
    passes = -(-asked.count() * 5 // (MOST_QUESTIONS * 4))  # hashes deal them out unevenly
    if passes <= 1:
        parts = [asked]
    else:
        dealt = F.pmod(F.xxhash64("question_id", F.lit(7)), F.lit(passes))
        parts = [asked.filter(dealt == k) for k in range(passes)]
    scored, widths = None, set()
    for part in parts:
        rows = _cosines(vectors, part, depth, widths)
        scored = rows if scored is None else scored.unionByName(rows)
    # products are summed in any order: ties are by the rounded score
    return ranked(scored, F.desc(F.round("score", 9)), F.col("note_id"), depth=depth)


def _cosines(vectors: DataFrame, questions: DataFrame, depth: int, widths: set[int]) -> DataFrame:
    """question_id, note_id, score: the best `depth` of each batch of vectors for the questions of one pass; widths: those of the questions so far."""
    asked = questions.collect()
    widths |= {len(r.q) for r in asked}
    if len(widths) > 1:
        raise ValueError(f"questions of different widths: {sorted(widths)}")
    of_note, of_question = (df.schema[c].dataType for df, c in ((vectors, "note_id"), (questions, "question_id")))
    ids = [r.question_id for r in asked]
    shared = vectors.sparkSession.sparkContext.broadcast(np.array([r.q for r in asked], np.float64).reshape(len(asked), max(widths, default=0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            v, note = batch.column(1), batch.column(0)
            sizes = np.diff(v.offsets.to_numpy())
            if (sizes != q.shape[1]).any():
                raise ValueError(f"a vector has {int(sizes[sizes != q.shape[1]][0])} values, the questions have {q.shape[1]}: they come from different models")
            matrix = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            place = np.empty(batch.num_rows, np.int64)
            place[pc.array_sort_indices(note).to_numpy()] = np.arange(batch.num_rows)
            for k in range(0, len(q), QUESTIONS_AT_ONCE):
                scores = matrix @ q[k : k + QUESTIONS_AT_ONCE].T
                rounded = scores.round(9)
                for j in range(scores.shape[1]):
                    top = np.arange(len(place))
                    if len(top) > depth:  # those under the last one's score can't stay
                        top = np.nonzero(rounded[:, j] >= np.partition(rounded[:, j], -depth)[-depth])[0]
                    top = top[np.lexsort((place[top], -rounded[top, j]))][:depth]
                    yield pa.RecordBatch.from_arrays([pa.array([k + j] * len(top), pa.int32()), note.take(pa.array(top)), pa.array(scores[top, j])], names=["at", "note_id", "score"])

    rows = vectors.select("note_id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, f"at int, note_id {of_note.simpleString()}, score double")
    names = vectors.sparkSession.createDataFrame(list(enumerate(ids)), StructType([StructField("at", IntegerType()), StructField("question_id", of_question)]))
    return rows.join(F.broadcast(names), "at").select("question_id", "note_id", "score")


#: Questions of one pass over the vectors, about.
MOST_QUESTIONS = 10_000
#: Questions that one product takes: with a batch of 10,000 vectors, 20 MB of scores.
QUESTIONS_AT_ONCE = 256


def fuse(by_vector: DataFrame, by_words: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of two rankings (question_id, note_id, score, rank).

    A component that didn't rank a note has score 0 and rank 0 there.
    """
    v = by_vector.select("question_id", "note_id", F.col("score").alias("vector"), F.col("rank").alias("vector_rank"))
    w = by_words.select("question_id", "note_id", F.col("score").alias("lexical"), F.col("rank").alias("lexical_rank"))
    both = v.join(w, ["question_id", "note_id"], "full_outer")
    share = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    in_both = F.col("vector_rank").isNotNull() & F.col("lexical_rank").isNotNull()
    fused = both.select(
        "question_id", "note_id", (share("vector_rank") + share("lexical_rank") + F.when(in_both, F.lit(BOTH_BONUS)).otherwise(F.lit(0.0))).alias("fused"), in_both.alias("both"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("vector", "lexical", "vector_rank", "lexical_rank")],
    )
    return ranked(fused, F.desc("fused"), F.col("vector_rank") == 0, F.col("vector_rank"), F.col("lexical_rank"))


def silence(by_vector: DataFrame, by_words: DataFrame, questions: DataFrame, floor: float = FLOOR) -> DataFrame:
    """question_id, best, matched, silent: silent if no word matched and the best cosine is under the floor."""
    best = by_vector.groupBy("question_id").agg(F.max("score").alias("best"))
    matched = by_words.groupBy("question_id").agg(F.count("*").alias("matched"))
    return _silent(questions.select("question_id").join(best, "question_id", "left").join(matched, "question_id", "left"), floor)


def silence_of(fused: DataFrame, questions: DataFrame, floor: float = FLOOR) -> DataFrame:
    """silence() from fuse() of both rankings, which holds every row of either."""
    found = fused.groupBy("question_id").agg(F.max(F.when(F.col("vector_rank") > 0, F.col("vector"))).alias("best"), F.count_if(F.col("lexical_rank") > 0).alias("matched"))
    return _silent(questions.select("question_id").join(found, "question_id", "left"), floor)


def _silent(rows: DataFrame, floor: float) -> DataFrame:
    return rows.na.fill(0, ["matched"]).withColumn("silent", (F.col("matched") == 0) & (F.coalesce("best", F.lit(0.0)) < floor))


def within_budget(notes: DataFrame, budget: int = BUDGET, order: str = "note_id") -> DataFrame:
    """Notes (doc_id, text and the column of their order) of each document in order while their characters fit; the first always."""
    w = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = notes.withColumn("used", F.sum(F.length("text")).over(w)).withColumn("nth", F.count("*").over(w))
    return run.filter((F.col("used") <= budget) | (F.col("nth") == 1)).drop("nth")


def lift_asked_dates(shown: DataFrame, asked: DataFrame, by: str = "rank") -> DataFrame:
    """shown (question_id, rank, date) with a place: notes of a date that the question names come first, else by rank."""
    named = asked.select("question_id", "date").distinct().withColumn("asked", F.lit(True))
    rows = shown.join(named, ["question_id", "date"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    w = Window.partitionBy("question_id").orderBy(F.desc("asked"), by)
    return rows.withColumn("place", F.row_number().over(w))


def rerank(candidates: DataFrame, scorer, depth: int = SHOWN) -> DataFrame:
    """candidates (question_id, question, note_id, text, rank) by scorer(question, text), a column function, highest first.

    Pass only what is left after the cut to CANDIDATES: the scorer may be a model. A question
    of which it leaves any note without a score (null) keeps the fused order, rerank null.
    """
    scored = candidates.filter(F.col("rank") <= CANDIDATES).withColumn("rerank", scorer(F.col("question"), F.col("text")))
    whole = F.count_if(F.col("rerank").isNull()).over(Window.partitionBy("question_id")) == 0
    scored = scored.withColumn("rerank", F.when(whole, F.col("rerank").cast("double")))
    return ranked(scored.withColumnRenamed("rank", "fused_rank"), F.desc_nulls_last("rerank"), F.col("fused_rank"), depth=depth)
