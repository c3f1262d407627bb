"""Queries of answers, stores, limits, streams' batch twins, evaluation and relational extensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import admission, answers, evaluation
from ..operators import retrieval as rt
from ..regex import quoted
from ..sources import store
from ..streaming import limits
from . import corpora
from .corpora import DIARY_SQL
from .registry import query

# ---- answers ----------------------------------------------------------------------

_SHOWN = f"{DIARY_SQL}, shown AS (SELECT doc_id AS question_id, idx + 1 AS rank, coalesce(date_raw, heading, 'Entry ' || (idx + 1)) AS label, date, text FROM diary)"


def shown(read):
    """Every entry of a diary, as what was shown for a question to it."""
    d = corpora.diary(read)
    label = F.coalesce("date_raw", "heading", F.concat(F.lit("Entry "), (F.col("idx") + 1).cast("string")))
    return d.select(F.col("doc_id").alias("question_id"), (F.col("idx") + 1).alias("rank"), label.alias("label"), "date", "text")


@query("answer_details", f"""WITH {_SHOWN}, l AS (SELECT question_id, label, min(rank) AS rank FROM shown GROUP BY 1, 2), g AS (SELECT question_id, array_to_string(list(label ORDER BY rank)[1:12], '|') AS labels FROM l GROUP BY 1)
SELECT question_id, labels, count(DISTINCT date) AS dates, min(date) AS first_date, max(date) AS last_date, count(*) AS notes FROM shown JOIN g USING (question_id) GROUP BY question_id, labels""")
def answer_details(read):
    d = answers.details(shown(read))
    return d.select("question_id", F.array_join("labels", "|").alias("labels"), F.size("dates").cast("long").alias("dates"), "first_date", "last_date", "notes")


@query("prompt_notes", f"WITH {_SHOWN} SELECT question_id, string_agg('[' || label || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS notes FROM shown GROUP BY 1")
def prompt_notes(read):
    return answers.notes_text(shown(read))


@query("prompt_text", f"""WITH {_SHOWN}, n AS (SELECT question_id, string_agg('[' || label || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS notes, count(*) AS shown FROM shown GROUP BY 1)
SELECT question_id, 'FACTS COUNTED OVER THE WHOLE DOCUMENT' || chr(10) || 'None.' || chr(10) || chr(10) || 'NOTES' || chr(10) || CASE WHEN shown < 8 THEN 'You see ' || shown || ' of 8 notes.' ELSE 'You see every note of the document.' END || chr(10) || notes || chr(10) || chr(10) || 'QUESTION' || chr(10) || 'What was seen?'
 || chr(10) || chr(10) || 'Answer under WHAT THE DOCUMENT SAYS from the notes and facts alone, citing labels in square brackets; add WHAT IT SUGGESTS only if the notes support it. If they hold no answer, write: The document doesn''t say.' || chr(10) || 'Give dates as the notes write them.' AS prompt FROM n""")
def prompt_text(read):
    s = shown(read)
    n = answers.notes_text(s).join(s.groupBy("question_id").agg(F.count("*").alias("shown")), "question_id")
    text = answers.prompt(F.lit("What was seen?"), F.lit(None).cast("string"), F.col("notes"), F.col("shown"), F.lit(8), F.lit(True))
    return n.select("question_id", text.alias("prompt"))


@query("extractive_reply", rf"WITH {_SHOWN} SELECT question_id, 'WHAT THE DOCUMENT SAYS' || chr(10) || string_agg(CASE WHEN regexp_extract(text, '(?s)^\s*(.*?[.!?])(?:\s|$)', 1) = '' THEN substr(text, 1, 200) ELSE regexp_extract(text, '(?s)^\s*(.*?[.!?])(?:\s|$)', 1) END || ' [' || label || ']', ' ' ORDER BY rank) AS reply FROM shown WHERE rank + 0 <= 3 GROUP BY 1")
def extractive_reply(read):
    return answers.extractive_reply(shown(read))


def said_replies(read):
    """id, form, reply: what was said in conversations, put as models put their replies, with headings, with one forgotten, or as a refusal."""
    c = read("conversations")
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    form = (F.col("conv_id") + F.col("turn")) % 4
    reply = (
        F.when(form == 0, F.concat(F.lit("WHAT THE DOCUMENT SAYS\nFirst: "), said, F.lit(".\n\nWHAT IT SUGGESTS\nThen: "), said, F.lit(".")))
        .when(form == 1, F.concat(F.lit("THE DOCUMENT SAYS: Once: "), said, F.lit(". WHAT THE DIARY SUGGESTS Nothing further.")))
        .when(form == 2, F.concat(F.lit("Only: "), said, F.lit(".")))
        .otherwise(F.concat(F.lit("The diary doesnt say\n"), said))
    )
    return c.select("conv_id", "turn", reply.alias("reply"))


_SAID = r"regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '', '')"


@query("reply_parse", rf"""WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 4 AS form, {_SAID} AS said FROM conversations)
SELECT conv_id, turn, CASE form WHEN 0 THEN 'First: ' || said || '.' WHEN 1 THEN 'Once: ' || said || '.' WHEN 2 THEN 'Only: ' || said || '.' ELSE regexp_replace('The diary doesnt say' || chr(10) || said, '\s+$', '') END AS says,
 CASE form WHEN 0 THEN 'Then: ' || said || '.' WHEN 1 THEN 'Nothing further.' END AS suggests, form = 3 AS refusal, form <> 0 AS nothing FROM c""")
def reply_parse(read):
    s = answers.read_reply(F.col("reply"))
    return said_replies(read).select("conv_id", "turn", s["says"].alias("says"), s["suggests"].alias("suggests"), answers.is_refusal(F.col("reply")).alias("refusal"), answers.nothing_further(s["suggests"]).alias("nothing"))


@query("refusal_detect", r"SELECT conv_id, turn, regexp_matches(CASE WHEN turn % 3 = 0 THEN 'The document doesn''t say.' ELSE text END, '(?i)^\s*the (document|diary)\s*(doesn''?t|does ?not)\s*say\b') AS refused FROM conversations")
def refusal_detect(read):
    reply = F.when(F.col("turn") % 3 == 0, F.lit(answers.REFUSAL)).otherwise(F.col("text"))
    return read("conversations").select("conv_id", "turn", answers.is_refusal(reply).alias("refused"))


@query("refused_by", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND NOT (conv_id % 3 = 0 AND conv_id % 5 < 3) THEN 'search' WHEN (conv_id + turn) % 4 = 3 THEN 'model' END AS refused_by FROM conversations")
def refused_by(read):
    c = F.col("conv_id")
    return said_replies(read).select("conv_id", "turn", answers.refused_by(F.col("turn") % 2 == 0, c % 5 < 3, c % 3 == 0, F.col("reply")).alias("refused_by"))


# ---- store ------------------------------------------------------------------------


@query("document_text", f"WITH {corpora.DIARY_TEXT_SQL} SELECT doc_id, text FROM diary_text")
def document_text(read):
    return store.document_text(corpora.diary(read))


@query("newest_by_fingerprint", "SELECT sha256(text) AS fingerprint, arg_max(doc_id, n_chars * 1000000 + doc_id) AS doc_id FROM documents GROUP BY 1")
def newest_by_fingerprint(read):
    d = read("documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"), (F.col("n_chars") * 1_000_000 + F.col("doc_id")).alias("created_at"))
    return store.newest(d)


@query("distinct_images", "SELECT page_id AS doc_id, min(k) AS pos, 'u' || (k % 3) AS url FROM pages, range(6) r(k) GROUP BY 1, 3")
def distinct_images(read):
    rows = read("pages").select(F.col("page_id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos"))
    images = rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.concat(F.lit("u"), (F.col("pos") % 3).cast("string")).alias("url"), F.lit("c").alias("caption"))
    return store.distinct_images(images).drop("caption")


@query("delete_cascade", "SELECT o_custkey, count(*) AS entries FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1")
def delete_cascade(read):
    """Entries of documents that weren't deleted (customers in debt are)."""
    gone = read("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("doc_id"))
    left = store.without(read("orders").withColumnRenamed("o_custkey", "doc_id"), gone)
    return left.groupBy(F.col("doc_id").alias("o_custkey")).agg(F.count("*").alias("entries"))


@query("purge_expired", "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 24 HOUR >= TIMESTAMP '1998-01-01 00:00:00'")
def purge_expired(read):
    d = read("orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"))
    return admission.unexpired(d, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).select("o_orderkey")


@query("housekeeping", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(DISTINCT conv_id) FROM conversations")
def housekeeping(read):
    one = lambda name, agg: read(name).agg(F.lit(name).alias("name"), agg.alias("n"))
    return one("documents", F.count("*")).unionByName(one("pages", F.count("*"))).unionByName(one("conversations", F.count_distinct("conv_id")))


@query("notes_by_id", "SELECT doc_id, length(text) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def notes_by_id(read):
    d, ids = read("documents"), read("labels").filter("quality = 1").select("doc_id")
    return d.join(ids, "doc_id", "left_semi").select("doc_id", F.length("text").cast("long").alias("chars"))


# ---- limits -------------------------------------------------------------------------

_MS = "(epoch_us(ts) // 1000)"
_WINDOW_MS, _LIMIT, _ALLOWANCE = 86_400_000, 3, 400


def limited_events(read):
    e = read("events")
    return e.select(F.col("user_id").alias("key"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at"), F.col("event_id").alias("seq"), F.coalesce(F.floor(F.abs("value")), F.lit(0)).alias("amount"))


@query("rate_limit_fixed_window", f"""WITH RECURSIVE e AS (SELECT user_id AS key, {_MS} AS t, event_id AS seq FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS k FROM e),
w AS (SELECT key, t, seq, k, t + {_WINDOW_MS} AS until, 1 AS used FROM n WHERE k = 1 UNION ALL SELECT n.key, n.t, n.seq, n.k, CASE WHEN w.until < n.t THEN n.t + {_WINDOW_MS} ELSE w.until END, CASE WHEN w.until < n.t THEN 1 ELSE w.used + 1 END FROM w JOIN n ON n.key = w.key AND n.k = w.k + 1)
SELECT key, seq, used::BIGINT AS used, used <= {_LIMIT} AS allowed FROM w""")
def rate_limit_fixed_window(read):
    return admission.decide(limited_events(read), "requests", _LIMIT, _WINDOW_MS).select("key", "seq", "used", "allowed")


@query("char_budget", f"""WITH RECURSIVE e AS (SELECT user_id AS key, {_MS} AS t, event_id AS seq, coalesce(floor(abs(value)), 0)::BIGINT AS a FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS k FROM e),
w AS (SELECT key, t, seq, k, t + {_WINDOW_MS} AS until, CASE WHEN a <= {_ALLOWANCE} THEN a ELSE 0 END AS used, a <= {_ALLOWANCE} AS allowed, CASE WHEN a <= {_ALLOWANCE} THEN 0 ELSE {_WINDOW_MS} END AS wait_ms FROM n WHERE k = 1
 UNION ALL SELECT n.key, n.t, n.seq, n.k, CASE WHEN w.until <= n.t THEN n.t + {_WINDOW_MS} ELSE w.until END, CASE WHEN w.until <= n.t THEN CASE WHEN n.a <= {_ALLOWANCE} THEN n.a ELSE 0 END WHEN w.used + n.a > {_ALLOWANCE} THEN w.used ELSE w.used + n.a END,
 CASE WHEN w.until <= n.t THEN n.a <= {_ALLOWANCE} ELSE w.used + n.a <= {_ALLOWANCE} END, CASE WHEN w.until <= n.t THEN CASE WHEN n.a <= {_ALLOWANCE} THEN 0 ELSE {_WINDOW_MS} END WHEN w.used + n.a > {_ALLOWANCE} THEN w.until - n.t ELSE 0 END FROM w JOIN n ON n.key = w.key AND n.k = w.k + 1)
SELECT key, seq, used::BIGINT AS used, allowed, wait_ms::BIGINT AS wait_ms FROM w""")
def char_budget(read):
    return admission.decide(limited_events(read), "chars", _ALLOWANCE, _WINDOW_MS).select("key", "seq", "used", "allowed", "wait_ms")


@query("store_ceiling", "SELECT o_orderkey, o_totalprice * 1000 >= 157286400 AS is_full, CASE WHEN greatest(1, ceil(o_orderkey / 60000.0))::INT = 1 THEN '1 minute' ELSE greatest(1, ceil(o_orderkey / 60000.0))::INT || ' minutes' END AS wait FROM orders")
def store_ceiling(read):
    return read("orders").select("o_orderkey", admission.store_is_full(F.col("o_totalprice") * 1000).alias("is_full"), admission.minutes_until(F.col("o_orderkey")).alias("wait"))


# ---- windows over events (batch twins of the streams) --------------------------------


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(read):
    e = read("events")
    return limits.tumbling(e, "ts", "1 day", F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), by=("event_type",))


@query("events_session", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def events_session(read):
    return limits.sessions(read("events"), "ts", "6 hours", F.count("*").alias("n"), by=("user_id",))


# ---- evaluation ----------------------------------------------------------------------

_CAL = f"""q AS (SELECT vec_id, vec_id % 100 < 50 AS noise, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 IN (3, 4)),
c AS (SELECT q.vec_id, noise, max(list_dot_product(q.v, e.embedding::DOUBLE[])) AS best FROM q, embeddings e WHERE e.vec_id <> q.vec_id GROUP BY 1, 2)"""


@query("calibrate_floor", f"WITH {_CAL} SELECT round(max(best) FILTER (WHERE noise), 6) AS noise_top, round(min(best) FILTER (WHERE NOT noise), 6) AS signal_low, CASE WHEN min(best) FILTER (WHERE NOT noise) > max(best) FILTER (WHERE noise) THEN round((min(best) FILTER (WHERE NOT noise) + max(best) FILTER (WHERE noise)) / 2, 6) END AS floor FROM c")
def calibrate_floor(read):
    """The midpoint between the best cosine of noise and the worst of real questions, if they part; questions are vectors of the table."""
    e = read("embeddings").select(F.col("vec_id").alias("note_id"), vx.doubles(F.col("embedding")).alias("v"))
    q = e.filter("note_id % 50 IN (3, 4)").select(F.col("note_id").alias("question_id"), F.col("v").alias("q"))
    best = evaluation.best_cosines(rt.cosine_ranking(e, q, depth=2).filter("note_id <> question_id"))
    f = evaluation.refusal_floor(best.withColumn("noise", F.col("question_id") % 100 < 50))
    return f.select(F.round("noise_top", 6).alias("noise_top"), F.round("signal_low", 6).alias("signal_low"), F.round("floor", 6).alias("floor"))


_RUNS = "replies AS (SELECT doc_id AS case_id, idx % 3 AS run, string_agg(text, ' ' ORDER BY idx) AS reply, count(date) = 0 AS refused FROM diary GROUP BY 1, 2)"
_MUST, _MUST_NOT = [r"\$[0-9]+\.[0-9]{2}", r"(?i)boiler"], [r"(?i)oslo|invoice"]


def golden_runs(read):
    """(cases, replies): a case for each diary, with patterns that its replies must and mustn't match; a third of its entries is a run's reply."""
    d = corpora.diary(read)
    texts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    replies = d.groupBy(F.col("doc_id").alias("case_id"), (F.col("idx") % 3).alias("run")).agg(F.array_join(F.transform(texts, lambda x: x["text"]), " ").alias("reply"), (F.count("date") == 0).alias("refused"))
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    cases = d.select(F.col("doc_id").alias("case_id")).distinct().select("case_id", lits(_MUST).alias("must"), lits(_MUST_NOT).alias("must_not"), (F.col("case_id") % 7 == 0).alias("refuse"))
    return cases, replies


_JUDGED = rf"""{_RUNS}, judged AS (SELECT case_id, run, CASE WHEN case_id % 7 = 0 THEN refused ELSE NOT refused AND {" AND ".join(f"regexp_matches(reply, '{p}')" for p in _MUST)} AND NOT regexp_matches(reply, '{_MUST_NOT[0]}') END AS passed FROM replies)"""


@query("golden_cases", f"WITH {DIARY_SQL}, {_JUDGED} SELECT case_id, run, passed FROM judged")
def golden_cases(read):
    """Which replies of which runs pass their case."""
    return evaluation.judge(*golden_runs(read)).select("case_id", "run", "passed")


@query("golden_stability", f"WITH {DIARY_SQL}, {_JUDGED} SELECT case_id, count(*) AS runs, count(*) FILTER (WHERE passed) AS passes, count(*) FILTER (WHERE passed) IN (0, count(*)) AS stable FROM judged GROUP BY 1")
def golden_stability(read):
    return evaluation.stability(evaluation.judge(*golden_runs(read)))


_ITEMS = ["Hamilton", "Oslo", "boiler", "Fairview"]


@query("completeness", f"WITH {DIARY_SQL}, {_RUNS}, need AS (SELECT unnest([{', '.join(quoted(x) for x in _ITEMS)}]) AS item) SELECT case_id, run, count(*) FILTER (WHERE contains(lower(reply), lower(item))) AS named, count(*) AS needed FROM replies, need GROUP BY 1, 2")
def completeness(read):
    """How many of the items that an answer should name each reply names."""
    cases, replies = golden_runs(read)
    items = cases.select("case_id", F.explode(F.array(*[F.lit(x) for x in _ITEMS])).alias("item"))
    return evaluation.completeness(replies, items).select("case_id", "run", "named", "needed")


# ---- relational extensions --------------------------------------------------------------


@query("orders_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def orders_semi(read):
    return read("customer").join(read("orders").filter("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("orders_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def orders_anti(read):
    return read("customer").join(read("orders").filter("o_orderstatus = 'O'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("term_union", "SELECT word FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM conversations) INTERSECT SELECT word FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM benchmark)")
def term_union(read):
    words = lambda t: read(t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("word")).distinct()
    return words("conversations").intersect(words("benchmark"))


@query("approx_terms")
def approx_terms(read):
    """Distinct words of each language, estimated."""
    words = read("documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("w"))
    return words.groupBy("lang").agg(F.approx_count_distinct("w").alias("words"))


@query("busiest_month", f"WITH {DIARY_SQL}, m AS (SELECT doc_id, month, count(*) AS n FROM diary WHERE month IS NOT NULL GROUP BY 1, 2) SELECT doc_id, month, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, month) AS k FROM m) WHERE k = 1")
def busiest_month(read):
    d = corpora.diary(read).filter("month IS NOT NULL").groupBy("doc_id", "month").agg(F.count("*").alias("n"))
    return d.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "month"))).filter("k = 1").drop("k")
