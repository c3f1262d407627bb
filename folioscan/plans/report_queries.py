"""Queries of facts, gaps, contradictions and chart series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..lexicons import GAP_SCAFFOLD, NEVER_MISSPELT
from ..operators import entities as en
from ..operators import facts as fx
from ..operators import retrieval as rt
from ..operators import stats
from ..operators import timeline as tl
from ..regex import quoted
from ..session import durable
from . import corpora
from .corpora import DIARY_SQL, DIARY_TEXT_SQL, JOBS_SQL
from .mention_queries import _FOUND, _PRESENT, found_mentions, present_mentions
from .registry import query
from .search_queries import _FUSED, _LEX60, _OTHER, ASKED_SQL, PROPER_NOUNS_SQL, SUBJECT_TERMS_SQL, asked, other_ranking, word_ranking

_LIST = lambda words: "[" + ", ".join(quoted(w) for w in words) + "]"

_STATS = "stats AS (SELECT doc_id, count(date) AS dated, arg_min(date, idx) FILTER (WHERE date IS NOT NULL) AS first_date, arg_max(date, idx) FILTER (WHERE date IS NOT NULL) AS last_date FROM diary GROUP BY doc_id)"


@query("range_facts", f"WITH {DIARY_SQL}, {_STATS} SELECT doc_id, 'date-range' AS kind, strftime(first_date, '%Y-%m-%d') || ' to ' || strftime(last_date, '%Y-%m-%d') AS value_text, first_date, last_date, dated AS entries FROM stats WHERE dated > 0")
def range_facts(read):
    return fx.range_facts(corpora.diary(read))


_TERM_FACTS = rf"""{ASKED_SQL}, st AS ({SUBJECT_TERMS_SQL}), pn AS ({PROPER_NOUNS_SQL}),
asked AS (SELECT question_id, term, list_contains(string_split(names, '|'), term) AS proper FROM (SELECT question_id, unnest(string_split(terms, '|')) AS term FROM st WHERE terms <> '') JOIN pn USING (question_id)),
hit AS (SELECT doc_id, idx, date, term, len(regexp_extract_all(lower(text), '\b' || term || '\w{{0,3}}\b')) AS n FROM diary, (SELECT DISTINCT term FROM asked) WHERE regexp_matches(lower(text), '\b' || term)),
found AS (SELECT doc_id, term, sum(n)::BIGINT AS n, count(*) AS hits, arg_min_null(date, idx) AS f, arg_max_null(date, idx) AS l FROM hit GROUP BY 1, 2),
tf AS (SELECT question_id, doc_id, CASE WHEN coalesce(n, 0) > 0 THEN 'count' ELSE 'absent' END AS kind, term, coalesce(n, 0) AS value, CASE WHEN n > 0 THEN hits END AS entries, CASE WHEN n > 0 THEN f END AS first_date, CASE WHEN n > 0 THEN l END AS last_date
  FROM asked CROSS JOIN (SELECT DISTINCT doc_id FROM diary) LEFT JOIN found USING (doc_id, term) WHERE n > 0 OR proper)"""


@query("question_facts", f"WITH {DIARY_SQL}, {_TERM_FACTS} SELECT * FROM tf")
def question_facts(read):
    """Facts of every question about every diary."""
    return fx.term_facts(corpora.diary(read), asked(read))


@query("absent_terms", f"WITH {DIARY_SQL}, {_TERM_FACTS} SELECT question_id, term, count(*) AS documents FROM tf WHERE kind = 'absent' GROUP BY 1, 2")
def absent_terms(read):
    return fx.term_facts(corpora.diary(read), asked(read)).filter("kind = 'absent'").groupBy("question_id", "term").agg(F.count("*").alias("documents"))


@query("fact_sentences", f"""WITH {DIARY_SQL}, {_TERM_FACTS} SELECT question_id, doc_id, CASE WHEN kind = 'absent' THEN '* "' || term || '": looked for in all entries, found in none.'
 ELSE '* "' || term || '": counted ' || value || ' times, within ' || entries || ' entries' || CASE WHEN first_date IS NOT NULL THEN ' (from ' || strftime(first_date, '%Y-%m-%d') || ' to ' || strftime(last_date, '%Y-%m-%d') || ')' ELSE '' END || '.' END AS sentence FROM tf WHERE last_date IS NOT NULL OR first_date IS NULL""")
def fact_sentences(read):
    f = fx.term_facts(corpora.diary(read), asked(read)).filter("last_date IS NOT NULL OR first_date IS NULL")
    c = F.col
    return f.select("question_id", "doc_id", fx.fact_sentence(c("kind"), c("term"), c("value"), c("entries"), c("first_date"), c("last_date")).alias("sentence"))


_GAP_WORDS = lambda x: rf"list_transform(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}'']+'), lambda w: regexp_replace(w, '^[''’]+|[''’]+$', '', 'g'))"
_GAPS = rf"""gq AS (SELECT question_id, list_filter({_GAP_WORDS('question')}, lambda w: length(w) >= 4 AND NOT list_contains({_LIST(sorted(set(GAP_SCAFFOLD)))}, w)) AS t FROM questions),
gt AS (SELECT question_id, term, min(pos) AS pos FROM (SELECT question_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM gq) GROUP BY 1, 2),
gv AS (SELECT DISTINCT doc_id, unnest({_GAP_WORDS('text')}) AS word FROM diary_text),
gs AS (SELECT DISTINCT question_id, doc_id, term FROM gt, gv WHERE term = word OR (length(word) >= 4 AND starts_with(term, word)) OR starts_with(word, term) OR (substr(term, 1, 4) = substr(word, 1, 4) AND abs(length(term) - length(word)) <= 4)),
gg AS (SELECT question_id, doc_id, pos, term, s.term IS NOT NULL AS present FROM gt CROSS JOIN (SELECT doc_id FROM diary_text) LEFT JOIN gs s USING (question_id, doc_id, term))"""


@query("gap_report", f"WITH {DIARY_TEXT_SQL}, {ASKED_SQL}, {_GAPS} SELECT question_id, doc_id, coalesce(array_to_string(list(term ORDER BY pos) FILTER (WHERE NOT present)[1:6], '|'), '') AS absent, count(*) FILTER (WHERE NOT present) AS absent_total, count(*) FILTER (WHERE present) AS present_count FROM gg GROUP BY 1, 2")
def gap_report(read):
    docs = corpora.diary_documents(read)
    r = fx.gap_report(fx.gaps(docs, asked(read)))
    return r.withColumn("absent", F.array_join("absent", "|"))


@query("out_of_order", f"""WITH {DIARY_SQL}, d AS (SELECT doc_id, idx, date, coalesce(date_raw, heading, 'entry ' || (idx + 1)) AS label, lag(date) OVER w AS previous_date, lag(coalesce(date_raw, heading, 'entry ' || (idx + 1))) OVER w AS previous_label FROM diary WHERE date IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM d WHERE date < previous_date) SELECT doc_id, idx, label, date, previous_date, previous_label, n FROM b WHERE n + 0 <= 3""")
def out_of_order(read):
    r = fx.out_of_order(corpora.diary(read))
    return r.withColumns({"idx": F.col("idx").cast("long"), "n": F.col("n").cast("long")})


_NEVER = _LIST(sorted(set(NEVER_MISSPELT)))
_POOL = rf"""pool AS (SELECT doc_id, list_filter(list_concat(regexp_extract_all(text, '\b[A-Z][\p{{L}}’''-]{{4,}}\b'), regexp_extract_all(text, '\b[A-Z][\p{{L}}’''-]+(?:\s+[A-Z][\p{{L}}’''-]+){{0,2}}\b')),
 lambda v: NOT list_has_any(list_transform(regexp_split_to_array(v, '\s+'), lambda p: regexp_replace(lower(p), '[^\p{{L}}]', '', 'g')), {_NEVER})) AS all_names FROM diary_text),
names AS (SELECT doc_id, name, min(pos) AS pos FROM (SELECT doc_id, unnest(all_names) AS name, unnest(range(len(all_names))) AS pos FROM pool) GROUP BY 1, 2)"""


@query("spelled_two_ways", rf"""WITH {DIARY_TEXT_SQL}, {_POOL} SELECT a.doc_id, a.name AS a, b.name AS b FROM names a JOIN names b ON a.doc_id = b.doc_id AND a.pos < b.pos AND substr(a.name, 1, 1) = substr(b.name, 1, 1) AND length(a.name) >= 5 AND length(b.name) >= 5
 AND len(regexp_split_to_array(a.name, '\s+')) = len(regexp_split_to_array(b.name, '\s+')) WHERE levenshtein(lower(a.name), lower(b.name)) BETWEEN 1 AND 2""")
def spelled_two_ways(read):
    return fx.spelled_two_ways(corpora.diary_documents(read), cap=None).select("doc_id", "a", "b")


@query("ambiguous_dates", f"""WITH {corpora.LEDGER_SQL}, m AS (SELECT doc_id, idx, substr(text, 1, 10) AS raw, substr(text, 1, 2)::INT AS a, substr(text, 4, 2)::INT AS b FROM ledger), r AS (SELECT doc_id, raw, row_number() OVER (PARTITION BY doc_id ORDER BY idx, raw) AS n FROM m WHERE a <> b AND a <= 12 AND b <= 12) SELECT doc_id, raw AS label, raw, n FROM r WHERE n + 0 <= 3""")
def ambiguous_dates(read):
    from ..functions import dates

    l = corpora.ledger(read).withColumn("h", dates.date_hits(F.col("text")))  # noqa: E741
    hit = F.get("h", F.lit(0))
    rows = l.select("doc_id", "idx", (hit["says"] == dates.UNCLEAR).alias("ambiguous"), hit["raw"].alias("date_raw"), F.lit(None).cast("string").alias("heading"))
    return fx.ambiguous_dates(rows).withColumn("n", F.col("n").cast("long"))


# ---- charts ---------------------------------------------------------------------

_AXIS = f"""{_STATS}, pm AS (SELECT doc_id, month, count(*) AS entries FROM diary WHERE month IS NOT NULL GROUP BY 1, 2), own AS (SELECT doc_id, min(month) AS low, max(month) AS high FROM pm GROUP BY 1),
ab AS (SELECT doc_id, strptime(coalesce(strftime(first_date, '%Y-%m'), low) || '-01', '%Y-%m-%d') AS a, strptime(coalesce(strftime(last_date, '%Y-%m'), high) || '-01', '%Y-%m-%d') AS b FROM own LEFT JOIN stats USING (doc_id)),
axis AS (SELECT doc_id, strftime(unnest(generate_series(a, b, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM ab WHERE b >= a UNION ALL SELECT doc_id, month FROM pm JOIN ab USING (doc_id) WHERE b < a),
series AS (SELECT doc_id, month, coalesce(entries, 0) AS entries FROM axis LEFT JOIN pm USING (doc_id, month))"""


def month_series(read):
    d = corpora.diary(read)
    return tl.continuous_months(stats.entries_per_month(d), stats.document_stats(d))


@query("continuous_months", f"WITH {DIARY_SQL}, {_AXIS} SELECT doc_id, month, entries FROM series")
def continuous_months(read):
    return month_series(read).withColumn("entries", F.col("entries").cast("long"))


@query("empty_months", f"WITH {DIARY_SQL}, {_AXIS} SELECT doc_id, count(*) AS months, count(*) FILTER (WHERE entries = 0) AS empty FROM series GROUP BY 1")
def empty_months(read):
    return month_series(read).groupBy("doc_id").agg(F.count("*").alias("months"), F.count_if(F.col("entries") == 0).alias("empty"))


_GRID_ROWS = """gr AS (SELECT doc_id, kind, key, n, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n DESC, key) AS rank FROM (SELECT doc_id, kind, key, count(*) AS n FROM present GROUP BY 1, 2, 3)), rows3 AS (SELECT * FROM gr WHERE rank + 0 <= 3)"""


def grid_rows_of(p):
    t = p.groupBy("doc_id", "kind", "value").agg(F.count("*").alias("count"))
    return en.top_mentions(t, tl.GRID_ROWS)


@query("grid_rows", f"WITH {_PRESENT}, {_GRID_ROWS} SELECT doc_id, kind, key, n, rank FROM rows3")
def grid_rows(read):
    return grid_rows_of(present_mentions(read)).select("doc_id", "kind", F.lower("value").alias("key"), F.col("count").alias("n"), F.col("rank").cast("long").alias("rank"))


@query("mention_grid", f"""WITH {_PRESENT}, {_GRID_ROWS}, {_AXIS}, ed AS (SELECT d.doc_id, d.idx, coalesce(x.month, 'undated') AS month FROM diary d LEFT JOIN axis x USING (doc_id, month)),
c AS (SELECT p.doc_id, p.kind, p.key, e.month, count(*) AS notes FROM present p JOIN rows3 USING (doc_id, kind, key) JOIN ed e USING (doc_id, idx) GROUP BY 1, 2, 3, 4),
ax AS (SELECT doc_id, month FROM axis UNION SELECT doc_id, month FROM c WHERE month = 'undated') SELECT doc_id, r.kind, r.key, month, coalesce(notes, 0) AS notes FROM rows3 r JOIN ax USING (doc_id) LEFT JOIN c USING (doc_id, kind, key, month)""")
def mention_grid(read):
    held = durable(present_mentions(read))  # found once, read twice
    g = tl.mention_grid(held, grid_rows_of(held), month_series(read).select("doc_id", "month"), corpora.diary(read))
    return g.select("doc_id", "kind", F.lower("value").alias("key"), "month", F.col("notes").cast("long").alias("notes"))


_SPINE = """lab AS (SELECT doc_id, idx, coalesce(trim(heading), trim(date_raw), month, 'Entry ' || (idx + 1)) AS label, month, idx % 3 = 0 AS cited FROM diary)"""


@query("spine_entries", f"WITH {DIARY_SQL}, {_SPINE} SELECT doc_id, 'entry' AS mode, idx AS pos, label, cited, 1 AS entries FROM lab")
def spine_entries(read):
    return _spine(read, tl.SPINE_LIMIT)


def _spine(read, limit):
    d = corpora.diary(read)
    label = F.coalesce(F.trim("heading"), F.trim("date_raw"), "month", F.concat(F.lit("Entry "), (F.col("idx") + 1).cast("string")))
    s = tl.spine(d.select("doc_id", "idx", label.alias("label"), "month"), d.filter("idx % 3 = 0").select("doc_id", "idx"), limit)
    return s.withColumn("pos", F.col("pos").cast("long"))


@query("spine_runs", f"""WITH {DIARY_SQL}, {_SPINE}, o AS (SELECT *, CASE WHEN coalesce(month, 'undated') IS DISTINCT FROM lag(coalesce(month, 'undated')) OVER (PARTITION BY doc_id ORDER BY idx) THEN 1 ELSE 0 END AS opens, count(*) OVER (PARTITION BY doc_id) AS total FROM lab),
g AS (SELECT *, CASE WHEN total > 10 THEN sum(opens) OVER (PARTITION BY doc_id ORDER BY idx) - 1 ELSE idx END AS pos FROM o)
SELECT doc_id, CASE WHEN total > 10 THEN 'month' ELSE 'entry' END AS mode, pos::BIGINT AS pos, arg_min(CASE WHEN total > 10 THEN coalesce(month, 'undated') ELSE label END, idx) AS label, bool_or(cited) AS cited, count(*) AS entries FROM g GROUP BY doc_id, total, pos""")
def spine_runs(read):
    return _spine(read, 10)


_SPANS = f"""{JOBS_SQL}, sp AS (SELECT doc_id, idx, label, month AS f, CASE WHEN end_month >= month THEN end_month ELSE month END AS t0, end_month IS NULL AND open_ended AS o FROM jobs),
spans AS (SELECT doc_id, idx, label, f AS from_month, CASE WHEN o THEN greatest(t0, max(t0) OVER (PARTITION BY doc_id)) ELSE t0 END AS to_month, o AS open_ended FROM sp)"""


@query("spans", f"WITH {_SPANS} SELECT *, from_month = to_month AS point FROM spans")
def spans(read):
    return tl.spans(corpora.jobs(read)).withColumn("idx", F.col("idx").cast("long"))


@query("span_lanes")
def span_lanes(read):
    """Each period's row in the chart."""
    return tl.lanes(tl.spans(corpora.jobs(read)))


@query("axis_months", f"WITH {_SPANS} SELECT doc_id, min(from_month) AS from_month, max(to_month) AS to_month, (substr(max(to_month), 1, 4)::INT - substr(min(from_month), 1, 4)::INT) * 12 + substr(max(to_month), 6, 2)::INT - substr(min(from_month), 6, 2)::INT + 1 AS months FROM spans GROUP BY 1")
def axis_months(read):
    return tl.axis_months(tl.spans(corpora.jobs(read)))


@query("span_phrases", """SELECT p_partkey, CASE WHEN p_size < 24 THEN p_size || ' month' || CASE WHEN p_size = 1 THEN '' ELSE 's' END WHEN p_size % 12 = 0 THEN (p_size // 12) || ' year' || CASE WHEN p_size // 12 = 1 THEN '' ELSE 's' END
 ELSE (p_size // 12) || ' year' || CASE WHEN p_size // 12 = 1 THEN '' ELSE 's' END || ' ' || (p_size % 12) || ' month' || CASE WHEN p_size % 12 = 1 THEN '' ELSE 's' END END AS phrase FROM part""")
def span_phrases(read):
    return read("part").select("p_partkey", tl.span_phrase(F.col("p_size")).alias("phrase"))


@query("note_map", f"WITH {DIARY_SQL}, n AS (SELECT doc_id, idx AS note_id, length(text) AS chars, length(text) / sum(length(text)) OVER (PARTITION BY doc_id) AS share, count(*) OVER (PARTITION BY doc_id) AS notes FROM diary) SELECT doc_id, note_id, chars, round(share, 6) AS share, notes, round(max(share) OVER (PARTITION BY doc_id), 6) AS longest, notes > 1 AND max(share) OVER (PARTITION BY doc_id) > 0.5 AS dominated FROM n")
def note_map(read):
    n = tl.note_map(corpora.diary(read).select("doc_id", F.col("idx").cast("long").alias("note_id"), "text"))
    return n.select("doc_id", "note_id", "chars", F.round("share", 6).alias("share"), "notes", F.round("longest", 6).alias("longest"), "dominated")


#: What the two searches rank of the diaries' entries for each question; every fourth question's candidates count as weighed, every fifth as silent.
_STAGES = f"""{ASKED_SQL}, {DIARY_SQL}, {_LEX60}, {_OTHER}, {_FUSED}, stages AS (SELECT question_id, (SELECT count(*) FROM diary) AS notes, CASE WHEN question_id % 3 > 0 THEN count(*) END AS ranked,
 CASE WHEN question_id % 4 = 1 THEN least(30, count(*)) END AS reranked, least(8, count(*)) AS shown, question_id % 5 = 4 AS silent FROM ranked GROUP BY question_id)"""


@query("funnel", f"""WITH {_STAGES}, s AS (SELECT question_id, 0 AS step, 'in the document' AS label, notes FROM stages UNION ALL SELECT question_id, 1, 'matched the question', CASE WHEN silent THEN 0 END FROM stages
 UNION ALL SELECT question_id, 2, 'ranked by both searches', CASE WHEN NOT silent THEN ranked END FROM stages UNION ALL SELECT question_id, 3, 'weighed by the reranker', CASE WHEN NOT silent THEN reranked END FROM stages UNION ALL SELECT question_id, 4, 'shown to the model', CASE WHEN NOT silent THEN shown END FROM stages)
SELECT question_id, step, label, notes::BIGINT AS notes FROM s WHERE notes IS NOT NULL""")
def funnel(read):
    fused = rt.fuse(other_ranking(read), word_ranking(read)).groupBy("question_id").agg(F.count("*").alias("n"))
    notes, k, n = corpora.diary(read).agg(F.count("*").alias("notes")), F.col("question_id"), F.col("n")
    s = fused.crossJoin(F.broadcast(notes)).select("question_id", "notes", F.when(k % 3 > 0, n).alias("ranked"), F.when(k % 4 == 1, F.least(F.lit(30), n)).alias("reranked"), F.least(F.lit(8), n).alias("shown"), (k % 5 == 4).alias("silent"))
    return tl.funnel(s)


@query("composition", f"""WITH {_FOUND}, t AS (SELECT doc_id, kind, lower(value) AS key, count(*) AS n FROM found GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n DESC, key) AS rank FROM t)
SELECT doc_id, kind, key, n FROM r WHERE kind <> 'amount' AND rank + 0 <= CASE kind WHEN 'place' THEN 4 ELSE 3 END""")
def composition(read):
    """The four most named places and three people of each document."""
    t = en.tally(found_mentions(read, ("place", "person")))
    return en.top_mentions(t, {"place": 4, "person": 3}).select("doc_id", "kind", F.lower("value").alias("key"), F.col("count").alias("n"))


@query("score_bars", "SELECT event_id, round(greatest(0, least(1, value / 100)), 6) AS bar FROM events")
def score_bars(read):
    return read("events").select("event_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100)), 6).alias("bar"))


@query("percentiles", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, min(value) AS least, max(CASE WHEN i = floor(n * 0.5) THEN value END) AS middle, max(value) AS most FROM r GROUP BY 1")
def percentiles(read):
    """Least, middle and most by index floor(n / 2), not interpolated."""
    e = read("events").filter("value IS NOT NULL")
    w = Window.partitionBy("event_type")
    r = e.withColumn("i", F.row_number().over(w.orderBy("value")) - 1).withColumn("n", F.count("*").over(w))
    return r.groupBy("event_type").agg(F.min("value").alias("least"), F.max(F.when(F.col("i") == F.floor(F.col("n") * 0.5), F.col("value"))).alias("middle"), F.max("value").alias("most"))
