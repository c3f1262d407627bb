"""The engine: index documents, ask questions of them, describe them.

Everything is a DataFrame until it is stored or shown. Models are parameters:
`embed` is a column function of a text (default: hashed words), `scorer` one of
a question and a text (default: none), `chat` a function of prompts (default: quotes).
"""

from __future__ import annotations

import threading
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import dates
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import answers, entities, facts, questions, retrieval, segment, stats, timeline
from ..session import durable, ship
from ..sources.readers import admit
from ..sources.store import Store, View, document_text

DAY = "INTERVAL 24 HOURS"
#: Documents that the questions of one call may be about.
MOST_DOCUMENTS = 100_000


class Busy(RuntimeError):
    """As many jobs of a kind as are allowed run already; come back later."""


class Panels(Mapping):
    """DataFrames by name, each planned when it is first looked at."""

    def __init__(self, made: dict):
        self._made, self._known = made, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self._made[name]()
        return self._known[name]

    def __iter__(self):
        return iter(self._made)

    def __len__(self) -> int:
        return len(self._made)


class Gate:
    """Lets so many callers in at once and refuses the rest; cancel() stops the Spark jobs of those within."""

    def __init__(self, spark: SparkSession, name: str, most: int):
        self.spark, self.tag, self.most = spark, f"folioscan-{name}", most
        self.places = threading.BoundedSemaphore(most)

    def __enter__(self) -> None:
        if not self.places.acquire(blocking=False):
            raise Busy(f"{self.most} at once are allowed")
        self.spark.sparkContext.addJobTag(self.tag)

    def __exit__(self, *_) -> None:
        self.spark.sparkContext.removeJobTag(self.tag)
        self.places.release()

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


@dataclass
class Engine:
    spark: SparkSession
    path: str
    embed: object = vx.embed
    model: str = "hash-64"
    scorer: object = None
    chat: object = None
    finders: dict = field(default_factory=lambda: {"place": entities.places, "person": entities.full_names})

    config: Config = field(default_factory=Config.read)

    def __post_init__(self) -> None:
        ship(self.spark)
        self.store = Store(self.spark, self.path)
        self.indexing, self.asking = Gate(self.spark, "index", self.config.indexing), Gate(self.spark, "ask", self.config.asking)

    # ---- index ---------------------------------------------------------------

    def parts(self, docs: DataFrame) -> dict:
        """What is stored of prepared documents (doc_id, text, title, year_hint, source_name): each table, or how it is made of those before it."""
        text = F.col("text")
        documents = docs.select(
            "doc_id", F.coalesce("title", tx.guess_title(text)).alias("title"), "source_name", tx.fingerprint(text, self.model).alias("fingerprint"),
            F.length("text").alias("characters"), dates.assumed_year(segment.dominant_year(text), F.col("year_hint")).alias("assumed_year"), F.current_timestamp().alias("created_at"), F.expr(f"current_timestamp() + {DAY}").alias("expires_at"),
        )

        def notes(written) -> DataFrame:
            return segment.notes(written("entries")).withColumns({
                "note_id": F.xxhash64("doc_id", "entry_idx", "part"), "tokens": F.size(retrieval.tokens(text)), "places": entities.places(text), "people": entities.full_names(text),
                "amounts": entities.amounts(text), "images": F.regexp_extract_all(text, F.lit(r"\[image: ([^\]]+)\]"), F.lit(1)),
            })

        return {
            "documents": documents, "entries": segment.entries(docs), "notes": notes,
            "vectors": lambda written: written("notes").select("note_id", "doc_id", self.embed(tx.searchable(F.col("heading"), text)).alias("v")),
            "sizes": lambda written: retrieval.note_sizes(written("notes")), "postings": lambda written: retrieval.postings(written("notes")),
        }

    def tables(self, docs: DataFrame) -> dict[str, DataFrame]:
        """The tables of parts(), each as one plan."""
        out: dict[str, DataFrame] = {}
        for name, made in self.parts(docs).items():
            out[name] = made if isinstance(made, DataFrame) else made(out.__getitem__)
        return out

    def add(self, docs: DataFrame) -> dict[str, int]:
        """Store documents that aren't known yet by content; returns how many were added and refused."""
        with self.indexing:
            fit, refused = admit(docs)
            fit = fit.withColumn("fingerprint", tx.fingerprint(F.col("text"), self.model)).dropDuplicates(["fingerprint"])
            known = self.store.table("documents")
            if known is not None:
                fit = fit.join(known.select("fingerprint").distinct(), "fingerprint", "left_anti")
            fit = fit.drop("fingerprint").persist()
            try:
                counts = {"added": fit.count(), "refused": refused.count()}
                if counts["added"]:
                    self.store.insert(self.parts(fit), {"documents": counts["added"]})
            finally:
                fit.unpersist()
            return counts

    def known(self, docs: DataFrame) -> DataFrame:
        """doc_id, known_id: for documents whose content is stored already, the newest document that holds it."""
        fit, _ = admit(docs)
        prints = fit.select("doc_id", tx.fingerprint(F.col("text"), self.model).alias("fingerprint"))
        if self.store.table("documents") is None:
            return prints.select("doc_id", F.col("doc_id").alias("known_id")).limit(0)
        return prints.join(self.store.find(prints).withColumnRenamed("doc_id", "known_id"), "fingerprint").select("doc_id", "known_id")

    def stages(self) -> DataFrame:
        """batch, stage, seconds, share: how long each part of each insert took."""
        return self.store.timings()

    # ---- ask -----------------------------------------------------------------

    def rank(self, asked: DataFrame, view: View | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(vector ranking, word ranking, fused ranking) of questions (question_id, question, and q, their vectors, if these are there).

        With a doc_id, a question is put to that document: only its notes are ranked, and
        the statistics of words are its own.
        """
        view = view or self.store.view()
        vectors, index, sizes = (view.table(t) for t in ("vectors", "postings", "sizes"))
        scoped = "doc_id" in asked.columns
        vector = F.col("q") if "q" in asked.columns else self.embed(F.col("question")).alias("q")
        q = asked.select("question_id", vector, *[F.col("doc_id").alias("_asked")] * scoped)
        if not scoped:
            by_words = retrieval.bm25_indexed(index, sizes, asked).select("question_id", "note_id", "score", "rank")
            by_vector = retrieval.cosine_ranking(vectors.select("note_id", "v"), q)
            return by_vector, by_words, retrieval.fuse(by_vector, by_words)
        where = asked.select("question_id", "doc_id")
        ids = where.select("doc_id").distinct()
        own = retrieval.bm25_indexed(index.join(ids, "doc_id", "left_semi"), sizes.join(ids, "doc_id", "left_semi"), asked, per_document=True, depth=None)
        by_words = retrieval.ranked(own.drop("rank").join(where, ["question_id", "doc_id"]), F.col("score"), F.col("note_id"), depth=retrieval.DEPTH).select("question_id", "note_id", "score", "rank")
        near = vectors.join(q, F.col("doc_id") == F.col("_asked")).select("question_id", "note_id", vx.cosine(F.col("v"), F.col("q")).alias("score"))
        by_vector = retrieval.ranked(near, F.desc(F.round("score", 9)), F.col("note_id"), depth=retrieval.DEPTH)
        return by_vector, by_words, retrieval.fuse(by_vector, by_words)

    def ask(self, asked: DataFrame) -> Mapping[str, DataFrame]:
        """Panels for questions (question_id, question, and doc_id if a question is put to one document).

        A question to a document that asks for a list is answered from every note, in the
        document's order, as far as the budget goes; others from the notes that rank best, those of
        a date that the question names first. Counted facts go to the model, and where
        they answer a question about dates, a silent search doesn't refuse it.

        Questions, rankings, what is shown, facts, coverage and replies are each computed once, here, and written; panels
        read them. So the models are called once: embed and chat a question, scorer a candidate. Facts, gaps and reports are of
        the documents in question: the one that is asked, or those that are shown or, for a silent question, came nearest.
        """
        with self.asking:
            return self._ask(asked)

    def _ask(self, asked: DataFrame) -> Mapping[str, DataFrame]:
        view = self.store.view()
        notes, entries, sizes = (view.table(t) for t in ("notes", "entries", "sizes"))
        scoped = "doc_id" in asked.columns
        question, c = F.col("question"), F.col
        kept_columns = ["question_id", "question", *["doc_id"] * scoped]
        whole_document = questions.wants_everything(question) if scoped else F.lit(False)
        named = F.array_distinct(F.filter(F.transform(dates.date_hits(question), lambda h: h["date"]), lambda d: d.isNotNull()))
        q = durable(asked.select(*kept_columns, whole_document.alias("everything"), questions.asks_for_range(question).alias("asks_range"), self.embed(question).alias("q"), named.alias("dates")))
        asked = q.select(*kept_columns)
        fused = durable(self.rank(q, view)[2])
        # ---- silence: never for a question answered from all notes, nor for one that a fact answers
        total = self._totals(q, sizes, scoped)
        searched = retrieval.silence_of(fused, asked).join(q.select("question_id", "everything", "asks_range"), "question_id").join(total, "question_id", "left")
        if scoped:
            own_entries = durable(entries.join(F.broadcast(self._few(asked.select("doc_id").distinct())), "doc_id", "left_semi"))
            ranges = durable(facts.range_facts(own_entries))
            has_range = asked.join(ranges.select("doc_id"), "doc_id").select("question_id").distinct().withColumn("has_range", F.lit(True))
            searched = searched.join(has_range, "question_id", "left")
        else:
            searched = searched.withColumn("has_range", F.lit(False))
        judged = searched.na.fill(False, ["has_range"]).na.fill(0, ["total"])
        nothing = F.when(c("everything"), c("total") == 0).otherwise(c("silent"))
        judged = judged.withColumn("silent", nothing & ~(c("asks_range") & c("has_range")))
        # ---- what is shown
        columns = ["note_id", "doc_id", "label", "date", "text", "places", "people", "amounts", "images"]
        live = judged.filter("NOT silent").select("question_id")
        depth = retrieval.SHOWN if self.scorer is None else retrieval.CANDIDATES
        best = fused.filter(c("rank") <= depth).join(q.filter("NOT everything").select("question_id", "question"), "question_id").join(live, "question_id", "left_semi")
        best = notes.select(*columns).join(F.broadcast(best), "note_id")  # CANDIDATES rows a question
        if self.scorer is not None:
            best = retrieval.rerank(best, self.scorer)
        lifted = retrieval.lift_asked_dates(best.withColumnRenamed("rank", "ranked"), q.select("question_id", F.explode("dates").alias("date")), by="ranked")
        shown = lifted.select("question_id", *columns, c("place").alias("rank"), "fused", "vector", "lexical", (c("rerank") if self.scorer is not None else F.lit(None).cast("double")).alias("rerank"))
        if scoped:
            shown = shown.unionByName(self._whole(q.filter("everything"), notes, view.table("vectors"), columns), allowMissingColumns=True)
        shown = durable(shown)
        # ---- facts, over the whole of the documents in question
        if scoped:
            where = asked.select("question_id", "doc_id")
        else:
            # of a silent question, the documents that came nearest: what they lack is told
            nearest = fused.filter(c("rank") <= retrieval.SHOWN).join(judged.filter("silent").select("question_id"), "question_id", "left_semi").select("question_id", "note_id")
            nearest = notes.select("note_id", "doc_id").join(F.broadcast(nearest), "note_id").select("question_id", "doc_id")
            where = durable(shown.select("question_id", "doc_id").union(nearest).distinct())
            own_entries = durable(entries.join(F.broadcast(self._few(where.select("doc_id").distinct())), "doc_id", "left_semi"))
            ranges = facts.range_facts(own_entries)
        counted = durable(facts.term_facts(own_entries, asked, where))
        sentence = facts.fact_sentence(c("kind"), c("term"), c("value"), c("entries"), c("first_date"), c("last_date"))
        sentences = counted.select("question_id", "doc_id", "kind", sentence.alias("sentence"))
        if scoped:
            spans = ranges.join(where, "doc_id").withColumns({"term": F.lit(None).cast("string"), "value": F.lit(None).cast("long")})
            sentences = sentences.unionByName(spans.select("question_id", "doc_id", "kind", sentence.alias("sentence")))
        # ---- coverage, reply
        seen = shown.groupBy("question_id").agg(F.count("*").alias("shown"), F.count_if(c("rerank").isNotNull()).alias("reranked"))
        ranked = fused.groupBy("question_id").agg(F.count("*").alias("ranked"))
        coverage = durable(judged.join(seen, "question_id", "left").join(ranked, "question_id", "left").na.fill(0, ["shown", "reranked"]))
        steps = coverage.select("question_id", "silent", c("total").alias("notes"), F.when(~c("everything"), c("ranked")).alias("ranked"), F.when(c("reranked") > 0, c("reranked")).alias("reranked"), "shown")
        replies = durable(self.replies(asked, shown, sentences, coverage))
        refused = replies.join(coverage.select("question_id", "silent", "asks_range", "has_range"), "question_id")
        texts = lambda: document_text(own_entries)
        mentions = lambda: entities.tally(self._mentions(own_entries))
        return Panels({
            "shown": lambda: shown, "silence": lambda: coverage.drop("shown", "reranked", "ranked"), "coverage": lambda: coverage.drop("ranked"), "details": lambda: answers.details(shown), "tallies": lambda: answers.tallies(shown),
            "facts": lambda: counted, "range": lambda: ranges, "sentences": lambda: sentences, "gaps": lambda: facts.gap_report(facts.gaps(texts(), asked, where)), "said_once": lambda: facts.said_once(mentions()),
            "out_of_order": lambda: facts.out_of_order(own_entries), "spelled_two_ways": lambda: facts.spelled_two_ways(texts()), "ambiguous": lambda: facts.ambiguous_dates(own_entries),
            "replies": lambda: replies.drop("reply"), "refused": lambda: refused.select("question_id", answers.refused_by(c("silent"), c("has_range"), c("asks_range"), c("reply")).alias("refused_by")),
            "funnel": lambda: timeline.funnel(steps), "warnings": lambda: self.warnings(coverage),
        })

    @staticmethod
    def _few(ids: DataFrame) -> DataFrame:
        """Ids of documents in question, as many as questions or notes shown: a broadcast of counted size."""
        if ids.limit(MOST_DOCUMENTS + 1).count() > MOST_DOCUMENTS:
            raise ValueError(f"at most {MOST_DOCUMENTS} documents in question at once")
        return ids

    @staticmethod
    def _totals(q: DataFrame, sizes: DataFrame, scoped: bool) -> DataFrame:
        """question_id, total: notes that the question could be answered from."""
        if scoped:
            return q.select("question_id", "doc_id").join(sizes.select("doc_id", "notes"), "doc_id").groupBy("question_id").agg(F.sum("notes").alias("total"))
        return q.select("question_id").crossJoin(F.broadcast(sizes.agg(F.coalesce(F.sum("notes"), F.lit(0)).alias("total"))))

    def _whole(self, q: DataFrame, notes: DataFrame, vectors: DataFrame, columns: list[str]) -> DataFrame:
        """The notes of each question's document in order, as far as the budget goes, with their cosine."""
        at = F.struct("entry_idx", "part").alias("at")
        ordered = notes.join(q.select("doc_id").distinct(), "doc_id", "left_semi").select(*columns, at)
        kept = retrieval.within_budget(ordered, order="at").join(q.select("question_id", "doc_id", "q"), "doc_id")
        near = kept.join(vectors.select("note_id", "v"), "note_id").withColumn("vector", vx.cosine(F.col("v"), F.col("q")))
        rank = F.row_number().over(Window.partitionBy("question_id").orderBy("at"))
        return near.select("question_id", *columns, rank.alias("rank"), "vector")

    @staticmethod
    def _mentions(entries: DataFrame) -> DataFrame:
        """doc_id, idx, kind, value, pos of places, people and amounts of entries."""
        text = F.col("text")
        kinds = (("place", entities.places(text)), ("person", entities.full_names(text)), ("amount", entities.amounts(text)))
        found = F.array(*[F.struct(F.lit(kind).alias("kind"), values.alias("values")) for kind, values in kinds])
        each = entries.select("doc_id", "idx", F.explode(found).alias("k"))
        return each.select("doc_id", "idx", "k.kind", F.posexplode("k.values").alias("pos", "value"))

    def warnings(self, coverage: DataFrame) -> DataFrame:
        """question_id, warnings: what the reader should know of how the notes were chosen."""
        n = lambda name: F.col(name).cast("string")
        every = F.col("everything") & (F.col("total") > 0)
        said = [
            F.when(every & (F.col("shown") >= F.col("total")), F.concat(F.lit("This asks for a list: all "), n("total"), F.lit(" notes were read in order."))),
            F.when(every & (F.col("shown") < F.col("total")), F.concat(F.lit("This asks for a list, but only the first "), n("shown"), F.lit(" of "), n("total"), F.lit(" notes fit: it may be incomplete."))),
            F.when(F.col("silent"), F.lit("No note matched the question, and no counted fact answers it.")),
            F.when(F.lit(self.scorer is not None) & ~F.col("everything") & ~F.col("silent") & (F.col("reranked") == 0), F.lit("The reranker gave no scores: notes are in the order of the search.")),
        ]
        return coverage.select("question_id", F.array_compact(F.array(*said)).alias("warnings")).filter(F.size("warnings") > 0)

    def prompts(self, asked: DataFrame, shown: DataFrame, sentences: DataFrame, coverage: DataFrame) -> DataFrame:
        """question_id, prompt: counted facts, what is shown of how much, notes and the question.

        Facts are those of documents that the question is put to or that are shown for it; unless there is one document, each says of which.
        """
        scoped = "doc_id" in asked.columns
        if scoped:
            own, name = sentences, F.lit("")
        else:
            titles = self.store.table("documents").select("doc_id", "title")
            own = titles.join(F.broadcast(sentences), "doc_id", "right")
            name = F.concat(F.lit("["), F.coalesce("title", F.col("doc_id").cast("string")), F.lit("] "))
        lines = F.array_sort(F.collect_list(F.concat(name, F.col("sentence"))))
        listed = own.groupBy("question_id").agg(F.array_join(lines, "\n").alias("facts"))
        notes = answers.notes_text(shown)
        rows = asked.join(coverage.filter("NOT silent").select("question_id", "shown", "total", "asks_range"), "question_id").join(notes, "question_id", "left").join(listed, "question_id", "left")
        text = answers.prompt(F.col("question"), F.col("facts"), F.coalesce("notes", F.lit("None.")), F.col("shown"), F.col("total"), F.col("asks_range"), one_document=scoped)
        return rows.select("question_id", text.alias("prompt"))

    def replies(self, asked: DataFrame, shown: DataFrame, sentences: DataFrame, coverage: DataFrame) -> DataFrame:
        """question_id, reply, says, suggests, refused: from the chat model, or quotes of the best notes; range facts where they answer."""
        if self.chat is None:
            said = answers.extractive_reply(shown)
            facts_say = sentences.filter("kind = 'date-range'").groupBy("question_id").agg(F.concat(F.lit("WHAT THE DOCUMENT SAYS\n"), F.min("sentence")).alias("dated"))
            ranges = coverage.filter("asks_range").select("question_id").join(facts_say, "question_id")
            said = said.join(ranges, "question_id", "full_outer").select("question_id", F.coalesce("dated", "reply").alias("reply"))
        else:
            said = self.prompts(asked, shown, sentences, coverage).select("question_id", self.chat(F.col("prompt")).alias("reply"))
        said = asked.select("question_id").join(said, "question_id", "left").withColumn("reply", F.coalesce("reply", F.lit(answers.REFUSAL)))
        shape: Column = answers.read_reply(F.col("reply"))
        return said.select("question_id", "reply", shape["says"].alias("says"), shape["suggests"].alias("suggests"), answers.is_refusal(F.col("reply")).alias("refused"))

    def whole(self, doc_id) -> DataFrame:
        """The notes of a document in order, as far as the budget for a whole-document question goes."""
        n = self.store.table("notes").filter(F.col("doc_id") == doc_id)
        return retrieval.within_budget(n.select("doc_id", F.struct("entry_idx", "part").alias("at"), "label", "text"), order="at")

    # ---- describe ------------------------------------------------------------

    def describe(self) -> dict[str, DataFrame]:
        """Kinds, statistics, months, periods, mentions, grid, spine and note shares of all documents, and stage timings."""
        entries, notes = self.store.table("entries"), self.store.table("notes")
        texts = self.store.text()
        counted = stats.document_stats(entries)
        kinds = texts.join(counted.select("doc_id", "dated_entries"), "doc_id").select("doc_id", questions.kind_of(questions.kind_signals(F.col("text")), F.col("dated_entries")).alias("kind"))
        kinds = kinds.withColumn("label", questions.kind_label(F.col("kind"))).withColumn("suggestions", questions.suggestions(F.col("kind")))
        months = timeline.continuous_months(stats.entries_per_month(entries), counted)
        label = F.coalesce("heading", "date_raw", F.concat(F.lit("Entry "), (F.col("idx") + 1).cast("string")))
        labelled = entries.select("doc_id", "idx", label.alias("label"), "month", "end_month", "open_ended")
        held = durable(entities.mentions_in(entries, entities.accepted(texts, self.finders)))
        rows = entities.top_mentions(held.groupBy("doc_id", "kind", "value").agg(F.count("*").alias("count")), timeline.GRID_ROWS)
        return {
            "kinds": kinds, "stats": counted, "months": months, "periods": timeline.lanes(timeline.spans(labelled)), "mentions": held.groupBy("doc_id", "kind", "value").agg(F.count("*").alias("entries")),
            "grid": timeline.mention_grid(held, rows, months.select("doc_id", "month"), entries), "spine": timeline.spine(labelled.select("doc_id", "idx", "label", "month"), labelled.select("doc_id", "idx").limit(0), timeline.SPINE_LIMIT),
            "note_map": timeline.note_map(notes.select("doc_id", "note_id", "text")), "stages": self.stages(),
        }
