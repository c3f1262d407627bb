"""Queries of retrieval and question analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..lexicons import INTENTS, MONTHS, QUERY_STOP_WORDS, QUESTIONS, SUBJECT_STOP_WORDS
from ..operators import questions as qs
from ..operators import retrieval as rt
from ..regex import quoted, sql
from . import corpora
from .corpora import DIARY_SQL, DIARY_TEXT_SQL
from .registry import query

_LIST = lambda words: "[" + ", ".join(quoted(w) for w in words) + "]"
#: Questions put to documents and diaries.
ASKED = [
    (1, "What happened with thanedble and the relyand thing?"), (2, "Where is the boiler in Grimsby on 6 March 1995?"), (3, "Which enerent's words and well-known theation?"),
    (4, "How many euxaient leaux are named in 1996?"), (5, "What did Cecilia pay for the boiler in April, compared with May?"), (6, "Who is it?"), (7, "List every einheit and keitlich, please."),
    (8, "Where has this person worked?"), (9, "What is this document about?"), (10, "When does it start and end?"), (11, "name the most important dates"), (12, "where did they study, and where do they live now?"),
]
ASKED_SQL = "questions(question_id, question) AS (VALUES " + ", ".join(f"({k}::BIGINT, {quoted(q)})" for k, q in ASKED) + ")"


def asked(read):
    spark = read("region").sparkSession
    rows = ", ".join("({}L, '{}')".format(k, q.replace("'", "\\'")) for k, q in ASKED)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(question_id, question)")


#: The questions above, and whatever was said in conversations or is asked by benchmark items.
EVERY_SQL = ASKED_SQL + ", every_question AS (SELECT question_id, question FROM questions UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations WHERE text IS NOT NULL UNION ALL SELECT -1 - item_id, text FROM benchmark WHERE text IS NOT NULL)"


def every_question(read):
    said = read("conversations").filter("text IS NOT NULL").select((1_000_000 + F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("question_id"), F.col("text").alias("question"))
    items = read("benchmark").filter("text IS NOT NULL").select((-1 - F.col("item_id")).cast("long").alias("question_id"), F.col("text").alias("question"))
    return asked(read).union(said).union(items)


_FOLD = lambda x: f"translate(lower({x}), '{rt._ACCENTED}', '{rt._PLAIN}')"
_TOKENS = lambda x: f"regexp_extract_all({_FOLD(x)}, '[\\p{{L}}\\p{{N}}]+')"
_TERMS = rf"""list_filter(list_transform(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}''’-]+'), lambda t: regexp_replace(t, '[''’-]+$', '')),
  lambda t: (length(t) >= 2 OR regexp_matches(t, '[0-9]')) AND (regexp_matches(t, '[0-9]') OR NOT list_contains({_LIST(QUERY_STOP_WORDS)}, t)))"""
_EXPANDED = "list_concat(" + ", ".join(f"CASE WHEN regexp_matches(question, {quoted(f'(?i){chr(92)}b(?:{p}){chr(92)}b')}) THEN {_LIST(t)} ELSE [] END" for p, t in INTENTS) + ")"


@query("question_terms", f"WITH {EVERY_SQL} SELECT question_id, array_to_string({_TERMS}, '|') AS terms FROM every_question")
def question_terms(read):
    return every_question(read).select("question_id", F.array_join(rt.question_terms(F.col("question")), "|").alias("terms"))


@query("intent_expand", f"WITH {EVERY_SQL}, e AS (SELECT question_id, unnest({_EXPANDED}) AS term FROM every_question) SELECT DISTINCT question_id, term FROM e")
def intent_expand(read):
    return every_question(read).select("question_id", F.explode(rt.expansion_terms(F.col("question"))).alias("term"))


def bm25_sql(notes: str, expand: bool = False, depth: int = rt.DEPTH) -> str:
    """notes: a query of note_id, doc_id, text."""
    terms = f"list_concat({_TERMS}, {_EXPANDED})" if expand else _TERMS
    return rf"""
notes AS ({notes}), toks AS (SELECT note_id, doc_id, {_TOKENS('text')} AS t FROM notes), sizes AS (SELECT count(*) AS notes, avg(len(t)) AS mean FROM toks),
terms AS (SELECT DISTINCT question_id, term, {_TOKENS('term')} AS phrase, length(term) >= 4 AS is_prefix FROM (SELECT question_id, unnest({terms}) AS term FROM questions) WHERE len({_TOKENS('term')}) > 0),
phrases AS (SELECT DISTINCT phrase, is_prefix FROM terms),
flat AS (SELECT note_id, unnest(t) AS tok, unnest(range(len(t))) AS at FROM toks),
starts AS (SELECT f.note_id, f.at, p.phrase, p.is_prefix FROM flat f JOIN phrases p ON len(p.phrase) > 1 AND f.tok = p.phrase[1]),
single AS (SELECT f.note_id, p.phrase, p.is_prefix, count(*) AS f FROM flat f JOIN phrases p ON len(p.phrase) = 1 AND (f.tok = p.phrase[1] OR (p.is_prefix AND starts_with(f.tok, p.phrase[1]))) GROUP BY 1, 2, 3),
several AS (SELECT s.note_id, s.phrase, s.is_prefix, count(*) AS f FROM starts s JOIN toks k USING (note_id)
  WHERE k.t[s.at + 1 : s.at + len(s.phrase) - 1] = s.phrase[1 : len(s.phrase) - 1] AND (k.t[s.at + len(s.phrase)] = s.phrase[-1] OR (s.is_prefix AND starts_with(k.t[s.at + len(s.phrase)], s.phrase[-1]))) GROUP BY 1, 2, 3),
counted AS (SELECT * FROM single UNION ALL SELECT * FROM several), df AS (SELECT phrase, is_prefix, count(*) AS n FROM counted GROUP BY 1, 2),
parts AS (SELECT c.note_id, k.doc_id, phrase, is_prefix, greatest(ln((s.notes - d.n + 0.5) / (d.n + 0.5)), 1e-6) * c.f * 2.2 / (c.f + 1.2 * (0.25 + 0.75 * len(k.t) / s.mean)) AS part
  FROM counted c JOIN df d USING (phrase, is_prefix) JOIN toks k USING (note_id), sizes s),
scored AS (SELECT question_id, note_id, doc_id, -sum(part) AS score FROM terms JOIN parts USING (phrase, is_prefix) GROUP BY 1, 2, 3),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9), note_id) AS rank FROM scored) WHERE rank <= {depth})"""


@query("bm25_topk", f"WITH {ASKED_SQL}, {bm25_sql('SELECT doc_id AS note_id, doc_id, text FROM documents')} SELECT question_id, note_id, round(score, 6) AS score, rank FROM lexical")
def bm25_topk(read):
    notes = read("documents").select(F.col("doc_id").alias("note_id"), "doc_id", "text")
    # scores are summed in any order: ties are by the rounded one
    hits = rt.bm25(notes, asked(read), expand=False, depth=None).drop("rank")
    top = rt.ranked(hits, F.round("score", 9), F.col("note_id"), depth=rt.DEPTH)
    return top.select("question_id", "note_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_DIARY_NOTES = "SELECT doc_id * 1000 + idx AS note_id, doc_id, text FROM diary"


def diary_notes(read):
    return corpora.diary(read).select((F.col("doc_id") * 1000 + F.col("idx")).alias("note_id"), "doc_id", "text")


@query("bm25_expanded", f"WITH {ASKED_SQL}, {DIARY_SQL}, {bm25_sql(_DIARY_NOTES, expand=True)} SELECT question_id, note_id, round(score, 6) AS score, rank FROM lexical")
def bm25_expanded(read):
    hits = rt.bm25(diary_notes(read), asked(read), depth=None).drop("rank")
    top = rt.ranked(hits, F.round("score", 9), F.col("note_id"), depth=rt.DEPTH)
    return top.select("question_id", "note_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_Q = "SELECT vec_id AS question_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0"
_COSINE = f"""q AS ({_Q}), by_vector AS (SELECT * FROM (SELECT question_id, note_id, score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, note_id) AS rank FROM
 (SELECT question_id, vec_id AS note_id, list_dot_product(q.q, e.embedding::DOUBLE[]) AS score FROM embeddings e, q)) WHERE rank <= 60)"""


def vector_ranking(read):
    e = read("embeddings").select("vec_id", vx.doubles(F.col("embedding")).alias("v"))
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("v").alias("q"))
    return rt.cosine_ranking(e.withColumnRenamed("vec_id", "note_id"), q)


@query("cosine_topk", f"WITH {_COSINE} SELECT question_id, note_id, round(score, 6) AS score, rank FROM by_vector")
def cosine_topk(read):
    return vector_ranking(read).select("question_id", "note_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("max_cosine", f"WITH {_COSINE} SELECT question_id, round(max(score), 6) AS best FROM by_vector WHERE note_id <> question_id GROUP BY 1")
def max_cosine(read):
    return vector_ranking(read).filter("note_id <> question_id").groupBy("question_id").agg(F.round(F.max("score"), 6).alias("best"))


@query("normalise_vectors", "WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 5)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v) SELECT vec_id, round(CASE WHEN n > 0 THEN list_sum(list_transform(v, lambda x: x / n)) ELSE 0 END, 6) AS total, round(n, 6) AS norm FROM n")
def normalise_vectors(read):
    v = read("embeddings").select("vec_id", F.transform(vx.doubles(F.col("embedding")), lambda x: x * (F.col("vec_id") % 5)).alias("v"))
    total = F.aggregate(vx.unit(F.col("v")), F.lit(0.0), lambda s, x: s + x)
    return v.select("vec_id", F.round(total, 6).alias("total"), F.round(vx.norm(F.col("v")), 6).alias("norm"))


_SLOT = "list_reduce(list_transform(string_split(w, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (h * 31 + c) % 100003, 0) % 64"


@query("hash_embed", rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}'']{{3,}}')) AS w FROM documents), s AS (SELECT doc_id, {_SLOT} AS slot, count(*) AS n FROM w GROUP BY 1, 2),
t AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM s GROUP BY 1) SELECT doc_id, slot, round(n / norm, 6) AS value FROM s JOIN t USING (doc_id)""")
def hash_embed(read):
    e = read("documents").select("doc_id", F.posexplode(vx.embed(F.col("text"))).alias("slot", "value")).filter("value > 0")
    return e.select("doc_id", F.col("slot").cast("long").alias("slot"), F.round("value", 6).alias("value"))


_LEX60 = f"{bm25_sql(_DIARY_NOTES, expand=False)}, by_words AS (SELECT question_id, note_id, score, rank FROM lexical)"
# a second ranking of the same notes, by a hash of their ids, stands for the vectors of a model
_OTHER = "by_vector AS (SELECT * FROM (SELECT question_id, note_id, 1.0 / (1 + (note_id * 37 + question_id * 11) % 1009) AS score, row_number() OVER (PARTITION BY question_id ORDER BY (note_id * 37 + question_id * 11) % 1009, note_id) AS rank FROM questions, (SELECT doc_id * 1000 + idx AS note_id FROM diary)) WHERE rank <= 60)"


def other_ranking(read):
    n = diary_notes(read).select("note_id")
    k = (F.col("note_id") * 37 + F.col("question_id") * 11) % 1009
    rows = n.join(F.broadcast(asked(read)), how="cross").select("question_id", "note_id", (1.0 / (1 + k)).alias("score"), k.alias("k"))
    return rt.ranked(rows, F.col("k"), F.col("note_id"), depth=rt.DEPTH).drop("k")


def word_ranking(read):
    hits = rt.bm25(diary_notes(read), asked(read), expand=False, depth=None).drop("rank", "doc_id")
    return rt.ranked(hits, F.round("score", 9), F.col("note_id"), depth=rt.DEPTH)


_FUSED = """fused AS (SELECT question_id, note_id, coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + w.rank), 0) + CASE WHEN v.rank IS NOT NULL AND w.rank IS NOT NULL THEN 1.0 / 120 ELSE 0 END AS fused, v.rank IS NOT NULL AND w.rank IS NOT NULL AS both_lists, coalesce(v.rank, 0) AS vector_rank, coalesce(w.rank, 0) AS lexical_rank
 FROM by_vector v FULL OUTER JOIN by_words w USING (question_id, note_id)), ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(fused, 12) DESC, vector_rank = 0, vector_rank, lexical_rank) AS rank FROM fused)"""


@query("rrf_fusion", f"WITH {ASKED_SQL}, {DIARY_SQL}, {_LEX60}, {_OTHER}, {_FUSED} SELECT question_id, note_id, round(fused, 6) AS fused, both_lists, vector_rank, lexical_rank, rank FROM ranked")
def rrf_fusion(read):
    f = rt.fuse(other_ranking(read), word_ranking(read)).drop("rank")
    f = rt.ranked(f, F.desc(F.round("fused", 12)), F.col("vector_rank") == 0, F.col("vector_rank"), F.col("lexical_rank"))
    return f.select("question_id", "note_id", F.round("fused", 6).alias("fused"), F.col("both").alias("both_lists"), *[F.col(c).cast("long").alias(c) for c in ("vector_rank", "lexical_rank", "rank")])


@query("shown_notes", f"WITH {ASKED_SQL}, {DIARY_SQL}, {_LEX60}, {_OTHER}, {_FUSED} SELECT r.question_id, r.note_id, r.rank, n.text FROM ranked r JOIN notes n USING (note_id) WHERE r.rank <= 8")
def shown_notes(read):
    """The texts of the notes that are left: joined after the ranking."""
    f = rt.fuse(other_ranking(read), word_ranking(read)).drop("rank")
    f = rt.ranked(f, F.desc(F.round("fused", 12)), F.col("vector_rank") == 0, F.col("vector_rank"), F.col("lexical_rank"), depth=rt.SHOWN)
    return f.select("question_id", "note_id", F.col("rank").cast("long").alias("rank")).join(diary_notes(read).select("note_id", "text"), "note_id")


@query("silence_test", f"WITH {ASKED_SQL}, {DIARY_SQL}, {_LEX60}, {_OTHER} SELECT q.question_id, round(max(v.score), 6) AS best, coalesce(any_value(w.n), 0) AS matched, coalesce(any_value(w.n), 0) = 0 AND max(v.score) < 0.56 AS silent FROM questions q JOIN by_vector v USING (question_id) LEFT JOIN (SELECT question_id, count(*) AS n FROM by_words GROUP BY 1) w USING (question_id) GROUP BY 1")
def silence_test(read):
    return rt.silence(other_ranking(read), word_ranking(read), asked(read)).select("question_id", F.round("best", 6).alias("best"), "matched", "silent")


@query("whole_doc_budget", f"WITH {DIARY_SQL}, n AS (SELECT doc_id, idx, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY idx) AS used FROM diary) SELECT doc_id, idx, used::BIGINT AS used FROM n WHERE used <= 900 OR idx = 0")
def whole_doc_budget(read):
    n = corpora.diary(read).select("doc_id", F.col("idx").cast("long").alias("note_id"), "text")
    return rt.within_budget(n, 900).select("doc_id", F.col("note_id").alias("idx"), "used")


@query("asked_date_lift", f"WITH {DIARY_SQL}, s AS (SELECT doc_id AS question_id, idx + 1 AS rank, date FROM diary), a AS (SELECT doc_id AS question_id, max(date) AS asked FROM diary GROUP BY 1) SELECT question_id, rank, row_number() OVER (PARTITION BY question_id ORDER BY (coalesce(date = asked, false)) DESC, rank) AS place FROM s JOIN a USING (question_id)")
def asked_date_lift(read):
    d = corpora.diary(read).select(F.col("doc_id").alias("question_id"), (F.col("idx") + 1).cast("long").alias("rank"), "date")
    a = d.groupBy("question_id").agg(F.max("date").alias("date"))
    return rt.lift_asked_dates(d, a).select("question_id", "rank", F.col("place").cast("long").alias("place"))


@query("rerank_overlap")
def rerank_overlap(read):
    """The fused candidates by a stand-in scorer: how many of the question's words a note holds."""
    f = rt.fuse(other_ranking(read), word_ranking(read))
    c = f.filter(F.col("rank") <= rt.CANDIDATES).join(asked(read), "question_id").join(diary_notes(read).select("note_id", "text"), "note_id")
    scorer = lambda q, t: F.size(F.array_intersect(rt.tokens(q), rt.tokens(t))).cast("double")
    return rt.rerank(c.select("question_id", "question", "note_id", "text", "rank"), scorer).drop("text", "question")


# ---- questions -----------------------------------------------------------------

_NORM = r"regexp_replace(lower(regexp_replace(regexp_replace(question, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), '[?!.]+$', '')"
_OFFERED = "offered AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, {quoted(q)}, {str(w).lower()})" for k, q, w in QUESTIONS) + ") t(kind, question, everything))"
_KNOWN = {w: _LIST(sorted({q.strip().lower().rstrip("?!.") for _, q, e in QUESTIONS if e is w})) for w in (True, False)}
_ANY = lambda shapes: "(" + " OR ".join(f"regexp_matches(n, {quoted(sql(s))})" for s in shapes) + ")"
_SCOPE = f"CASE WHEN n = '' THEN false WHEN list_contains({_KNOWN[True]}, n) THEN true WHEN list_contains({_KNOWN[False]}, n) THEN false WHEN regexp_matches(n, {quoted(sql(qs.ONE_OFF))}) AND NOT regexp_matches(n, {quoted(sql(qs.STRONG))}) THEN false ELSE {_ANY(qs.LIST_SHAPES)} END"


@query("scope_classify", f"WITH {EVERY_SQL}, n AS (SELECT question_id, {_NORM} AS n FROM every_question) SELECT question_id, {_SCOPE} AS everything, {_ANY(qs.RANGE_SHAPES)} AS date_range FROM n")
def scope_classify(read):
    q = F.col("question")
    return every_question(read).select("question_id", qs.wants_everything(q).alias("everything"), qs.asks_for_range(q).alias("date_range"))


SUBJECT_TERMS_SQL = rf"""WITH t AS (SELECT question_id, list_filter(list_transform(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}''’-]{{2,}}'), lambda t: regexp_replace(t, '([''’]s|[''’-]+)$', '')), lambda t: length(t) >= 3 AND NOT list_contains({_LIST(sorted(set(SUBJECT_STOP_WORDS)))}, t)) AS t FROM questions)
SELECT question_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[1:6], '|') AS terms FROM t"""
PROPER_NOUNS_SQL = rf"""SELECT question_id, array_to_string(list_transform(regexp_extract_all(regexp_replace('_' || substr(question, 2), '^_[\p{{L}}''’.-]*', ''), '\b\p{{Lu}}[\p{{L}}''’.-]*'), lambda w: regexp_replace(lower(w), '[''’]s$', '')), '|') AS names FROM questions"""


_OVER_ALL = lambda x: x.replace("FROM questions", "FROM every_question")


@query("subject_terms", f"WITH {EVERY_SQL}, st AS ({_OVER_ALL(SUBJECT_TERMS_SQL)}) SELECT * FROM st")
def subject_terms(read):
    return every_question(read).select("question_id", F.array_join(qs.subject_terms(F.col("question")), "|").alias("terms"))


@query("proper_nouns", f"WITH {EVERY_SQL}, pn AS ({_OVER_ALL(PROPER_NOUNS_SQL)}) SELECT * FROM pn")
def proper_nouns(read):
    return every_question(read).select("question_id", F.array_join(qs.proper_nouns(F.col("question")), "|").alias("names"))


_MONTH_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(question), '\\b({m.lower()}|{m[:3].lower()})\\b') THEN {k + 1} END" for k, m in enumerate(MONTHS)) + "], lambda x: x IS NOT NULL)"


@query("months_named", f"WITH {EVERY_SQL} SELECT question_id, array_to_string({_MONTH_SQL}, '|') AS months FROM every_question")
def months_named(read):
    return every_question(read).select("question_id", F.array_join(F.transform(qs.months_named(F.col("question")), lambda x: x.cast("string")), "|").alias("months"))


def _hits(words: str) -> str:
    return f"regexp_extract_all(text, {quoted(f'(?i){chr(92)}b(?:{words}){chr(92)}b')})"


_TEXTS = rf"""texts AS (SELECT 'c' || conv_id AS id, string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text, chr(10) ORDER BY turn) AS text, 0 AS dated FROM conversations GROUP BY conv_id
 UNION ALL SELECT 'd' || doc_id, text, 0 FROM documents UNION ALL SELECT 'y' || doc_id, string_agg(text, chr(10) || chr(10) ORDER BY idx), count(date) FROM diary GROUP BY doc_id
 UNION ALL SELECT 'm' || n_nationkey, 'Agenda and minutes. Present: all. The chair resolved that the motion carried. Statement balance debit credit $1.00' || chr(10) || 'shall agreement party clause liability termination' || CASE WHEN n_nationkey % 2 = 0 THEN repeat(' word', 3000) ELSE '' END, 0 FROM nation)"""


def kind_texts(read):
    said = read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    line = lambda x: F.concat(F.upper(F.substring(x["role"], 1, 1)), F.substring(x["role"], 2, 1000), F.lit(": "), x["text"])
    c = said.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.array_join(F.transform("t", line), "\n").alias("text"), F.lit(0).alias("dated"))
    d = read("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")), "text", F.lit(0))
    rows = corpora.diary(read).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("e"), F.count("date").cast("int").alias("dated"))
    y = rows.select(F.concat(F.lit("y"), F.col("doc_id").cast("string")), F.array_join(F.transform("e", lambda x: x["text"]), "\n\n"), "dated")
    made = F.concat(F.lit("Agenda and minutes. Present: all. The chair resolved that the motion carried. Statement balance debit credit $1.00\nshall agreement party clause liability termination"), F.when(F.col("n_nationkey") % 2 == 0, F.repeat(F.lit(" word"), F.lit(3000))).otherwise(""))
    m = read("nation").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")), made, F.lit(0))
    return c.union(d).union(y).union(m)


_KIND = rf"""{_TEXTS}, s AS (SELECT id, dated, text, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS r,
 {", ".join(f"{_hits(w)} AS {k}" for k, w in (("job", qs.JOB), ("news", qs.NEWS), ("minutes", qs.MINUTES), ("policy", qs.POLICY), ("statement", qs.STATEMENT)))}, regexp_matches(text, {quoted(sql(qs.BYLINE))}) AS byline, regexp_matches(text, {quoted(sql(qs.STAMP))}) AS stamp,
 len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda b: NOT regexp_matches(b, '^\s*$'))) AS blocks FROM texts),
g AS (SELECT id, dated, length(text) AS chars, blocks, byline, stamp, list_filter(r, lambda x: length(x) <= 40 AND regexp_matches(x, {quoted(qs.SECTION)})) AS sections, len(list_filter(r, lambda x: length(x) <= 48 AND regexp_matches(x, {quoted(qs.JOB_SECTION)}))) AS job_sections,
 list_filter(r, lambda x: regexp_matches(x, {quoted(qs.SPEAKER)})) AS speakers, len(list_filter(r, lambda x: regexp_matches(x, {quoted(sql(qs.MONEY))}))) AS amount_lines,
 {", ".join(f"len(list_distinct(list_transform({k}, lambda w: lower(w)))) AS {k}_n, len({k}) * 1000.0 / greatest(length(text), 1) AS {k}_d" for k in ("job", "news", "minutes", "policy", "statement"))} FROM s)
SELECT id, CASE WHEN len(sections) >= 2 AND regexp_matches(array_to_string(sections, ' '), {quoted(qs.SECTION_ANCHOR)}) THEN 'resume' WHEN job_sections >= 2 OR (job_sections >= 1 AND job_n >= 3) OR job_n >= 6 THEN 'job'
 WHEN (byline AND stamp) OR (stamp AND news_n >= 4) OR (byline AND news_n >= 6) THEN 'news' WHEN len(speakers) >= 4 AND len(list_distinct(list_transform(speakers, lambda x: lower(string_split(x, ':')[1])))) >= 2 THEN 'transcript'
 WHEN minutes_n >= 3 AND minutes_d >= 0.5 THEN 'minutes' WHEN policy_n >= 5 AND policy_d >= 0.5 THEN 'policy' WHEN amount_lines >= 5 AND statement_n >= 3 AND statement_d >= 0.5 THEN 'statement'
 WHEN dated >= 3 AND blocks > 0 AND dated / blocks >= 0.4 THEN 'diary' WHEN chars >= 40000 THEN 'long' ELSE 'general' END AS kind FROM g"""


@query("doc_kind", f"WITH {DIARY_SQL}, {_KIND}")
def doc_kind(read):
    s = kind_texts(read).select("id", "dated", qs.kind_signals(F.col("text")).alias("s"))
    return s.select("id", qs.kind_of(F.col("s"), F.col("dated")).alias("kind"))


@query("marker_density", f"WITH {DIARY_SQL}, {_TEXTS} SELECT id, len({_hits(qs.MINUTES)}) AS hits, round(len({_hits(qs.MINUTES)}) * 1000.0 / greatest(length(text), 1), 6) AS density FROM texts")
def marker_density(read):
    m = kind_texts(read).select("id", "text", qs.markers(F.col("text"), qs.MINUTES)["hits"].alias("hits"))
    return m.select("id", F.col("hits").cast("long").alias("hits"), F.round(qs.density(F.col("text"), F.col("hits")), 6).alias("density"))


@query("offered_questions", f"WITH {DIARY_SQL}, k AS (WITH {_KIND}), {_OFFERED}, n AS (SELECT kind, question, {_NORM} AS n FROM offered) SELECT id, kind, question, {_SCOPE} AS everything FROM k JOIN n USING (kind)")
def offered_questions(read):
    """What is offered to be asked of each text, by its kind, and how it is classified."""
    s = kind_texts(read).select("id", "dated", qs.kind_signals(F.col("text")).alias("s"))
    kinds = s.select("id", qs.kind_of(F.col("s"), F.col("dated")).alias("kind"))
    rows = kinds.select("id", "kind", F.explode(qs.suggestions(F.col("kind"))).alias("question"))
    return rows.withColumn("everything", qs.wants_everything(F.col("question")))
