"""Queries of dates, entities and counts, over diaries and ledgers made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..lexicons import NOT_NAME_WORDS, OPENERS, PLACES
from ..operators import entities as en
from ..operators import stats
from ..regex import quoted, sql
from . import corpora
from .corpora import DIARY_SQL, DIARY_TEXT_SQL, JOBS_SQL, LEDGER_SQL
from .registry import query

_LIST = lambda words: "[" + ", ".join(quoted(w) for w in sorted({w.lower() for w in words})) + "]"
_MONTH_NAMES = "january|february|march|april|may|june|july|august|september|october|november|december"


@query("date_hits_dayfirst", rf"""WITH {DIARY_SQL} SELECT doc_id, idx, strftime(date, '%Y-%m-%d') AS date, date_raw AS raw, 0 AS position FROM diary WHERE date IS NOT NULL""")
def date_hits_dayfirst(read):
    """All dates that the six shapes find in diary entries: the written ones and no other."""
    rows = corpora.diary(read).select("doc_id", "idx", F.explode(dates.date_hits(F.col("text"))).alias("h"))
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), "h.date", "h.raw", F.col("h.start").alias("position"))


@query("date_hits_numeric", rf"""WITH {LEDGER_SQL}, m AS (SELECT doc_id, idx, substr(text, 1, 10) AS raw, substr(text, 1, 2)::INT AS a, substr(text, 4, 2)::INT AS b, substr(text, 7, 4) AS y FROM ledger)
SELECT doc_id, idx, raw, a <> b AND a <= 12 AND b <= 12 AS ambiguous, CASE WHEN a = b OR b > 12 THEN y || '-' || printf('%02d', a) || '-' || printf('%02d', b) END AS date FROM m""")
def date_hits_numeric(read):
    rows = corpora.ledger(read).select("doc_id", "idx", F.explode(dates.date_hits(F.col("text"))).alias("h"))
    return rows.select("doc_id", "idx", "h.raw", (F.col("h.says") == dates.UNCLEAR).alias("ambiguous"), "h.date")


@query("date_hits_iso", r"""SELECT event_id, regexp_extract_all('on ' || strftime(ts, '%Y-%m-%d') || ' and ' || strftime(ts, '%Y') || '-02-31, v1.' || event_id, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b')[1] AS date FROM events""")
def date_hits_iso(read):
    """The impossible 31 February claims nothing."""
    d = F.date_format("ts", "yyyy-MM-dd")
    text = F.concat(F.lit("on "), d, F.lit(" and "), F.substring(d, 1, 4), F.lit("-02-31, v1."), F.col("event_id").cast("string"))
    return read("events").select("event_id", F.explode(dates.date_hits(text)).alias("h")).filter("h.date IS NOT NULL").select("event_id", "h.date")


@query("date_validation", "SELECT event_id, try_cast(printf('%04d-%02d-%02d', 1990 + event_id % 40, event_id % 14, event_id % 33) AS DATE) AS date FROM events")
def date_validation(read):
    e = F.col("event_id")
    return read("events").select("event_id", dates.valid_date((1990 + e % 40).cast("int"), (e % 14).cast("int"), (e % 33).cast("int")).alias("date"))


@query("month_numbers", "SELECT o_orderkey, month(o_orderdate) AS n FROM orders")
def month_numbers(read):
    return read("orders").select("o_orderkey", dates.month_number(F.date_format("o_orderdate", "MMMM")).cast("long").alias("n"))


@query("dominant_year", rf"""WITH {DIARY_TEXT_SQL}, y AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b((?:19|20)[0-9]{{2}})\b', 1))::INT AS y FROM diary_text), c AS (SELECT doc_id, y, count(*) AS n FROM y GROUP BY 1, 2)
SELECT doc_id, arg_min(y, struct_pack(n := -n, y := y)) AS year FROM c GROUP BY 1""")
def dominant_year(read):
    from ..operators.segment import dominant_year as of

    return corpora.diary_documents(read).select("doc_id", of(F.col("text")).alias("year")).filter("year IS NOT NULL")


@query("entry_dates", rf"""WITH {DIARY_SQL} SELECT doc_id, idx, strftime(date, '%Y-%m-%d') AS date, date_raw, substr(strftime(date, '%Y-%m-%d'), 1, 7) AS month FROM diary""")
def entry_dates(read):
    """Entry dates read from the text alone."""
    hits = corpora.diary(read).select("doc_id", F.col("idx").cast("long").alias("idx"), dates.date_hits(F.col("text")).alias("h"))
    first = F.get(F.filter("h", lambda h: h["date"].isNotNull()), F.lit(0))
    return hits.select("doc_id", "idx", first["date"].alias("date"), first["raw"].alias("date_raw"), F.substring(first["date"], 1, 7).alias("month"))


@query("entry_period", f"WITH {JOBS_SQL} SELECT doc_id, idx, month, end_month, open_ended FROM jobs")
def entry_period(read):
    """Months, ends and still-running periods read from the text of job entries."""
    from ..functions.binding import batched

    found = batched("struct<month:string,end_month:string,open_ended:boolean>")(_periods)
    rows = corpora.jobs(read).select("doc_id", F.col("idx").cast("long").alias("idx"), found(F.col("text")).alias("p"))
    return rows.select("doc_id", "idx", "p.month", "p.end_month", "p.open_ended")


def _periods(text):
    import pandas as pd

    return pd.DataFrame([{k: d[k] for k in ("month", "end_month", "open_ended")} for d in map(dates.dates_of_entry, text)], columns=["month", "end_month", "open_ended"])


@query("display_dates", "SELECT o_orderkey, strftime(o_orderdate, '%-d %B %Y') AS display, strftime(o_orderdate, '%b %y') AS month_label, strftime(o_orderdate, '%Y-%m') AS month_key FROM orders")
def display_dates(read):
    d = "o_orderdate"
    return read("orders").select("o_orderkey", dates.display_date(d).alias("display"), dates.month_label(d).alias("month_label"), dates.month_key(d).alias("month_key"))


@query("assumed_years", r"SELECT doc_id, doc_id % 3 = 0 AND NOT regexp_matches(text, '\b(?:19|20)[0-9]{2}\b') AS assumed FROM documents WHERE text IS NOT NULL")
def assumed_years(read):
    """Documents whose dates would take the year that the reader gave (every third has one): those that name none."""
    from ..operators.segment import dominant_year as of

    d = read("documents").filter("text IS NOT NULL").select("doc_id", of(F.col("text")).alias("year"), F.when(F.col("doc_id") % 3 == 0, F.lit(2020)).alias("given"))
    return d.select("doc_id", dates.assumed_year(F.col("year"), F.col("given")).alias("assumed"))


_AMOUNT = sql(en.AMOUNT)


@query("amounts", f"WITH {DIARY_SQL} SELECT doc_id, idx, unnest(list_transform(regexp_extract_all(text, '{_AMOUNT}'), lambda x: trim(x))) AS amount FROM diary")
def amounts(read):
    return corpora.diary(read).select("doc_id", F.col("idx").cast("long").alias("idx"), F.explode(en.amounts(F.col("text"))).alias("amount"))


@query("honorifics", rf"WITH {DIARY_SQL} SELECT doc_id, idx, unnest(regexp_extract_all(text, {quoted(sql(en.HONORIFIC))}, 1)) AS name FROM diary")
def honorifics(read):
    return corpora.diary(read).select("doc_id", F.col("idx").cast("long").alias("idx"), F.explode(en.honorific_names(F.col("text"))).alias("name"))


_PHRASE = quoted(sql(rf"(?<![A-Za-z0-9_]){en.BEFORE_PLACE}\s+({en._CAP}(?:\s+{en._CAP}){{0,2}})"))
_ANY_WORD = lambda p: f"list_has_any(list_transform(regexp_split_to_array({p}, '[\\s.]+'), lambda w: lower(w)), {_LIST(NOT_NAME_WORDS)})"
_PLACES_OF = rf"""list_concat(
  list_filter(regexp_extract_all(text, {_PHRASE}, 1), lambda p: length(p) >= 3 AND NOT list_contains({_LIST(OPENERS)}, lower(regexp_split_to_array(p, '\s+')[1])) AND NOT {_ANY_WORD('p')} AND (len(regexp_split_to_array(p, '\s+')) > 1 OR list_contains({_LIST(PLACES)}, lower(p)))),
  list_filter(regexp_extract_all(text, '[A-Z][\p{{L}}''’.-]*'), lambda w: length(w) > 2 AND list_contains({_LIST(PLACES)}, lower(w))))"""


@query("gazetteer_places", f"WITH {DIARY_SQL} SELECT doc_id, idx, unnest({_PLACES_OF}) AS place FROM diary")
def gazetteer_places(read):
    return corpora.diary(read).select("doc_id", F.col("idx").cast("long").alias("idx"), F.explode(en.places(F.col("text"))).alias("place"))


_NAME_PAIR = quoted(sql(rf"(?<![A-Za-z0-9_]){en._NAME}\s+{en._NAME}(?:\s+{en._NAME})?"))
_NAMES_OF = rf"""list_filter(list_transform(regexp_extract_all(text, {_NAME_PAIR}), lambda p: regexp_replace(p, '\s+', ' ', 'g')), lambda p:
  NOT list_contains({_LIST([*OPENERS, *PLACES])}, lower(string_split(p, ' ')[1])) AND NOT (length(string_split(p, ' ')[1]) > 1 AND string_split(p, ' ')[1] = upper(string_split(p, ' ')[1])) AND NOT list_contains({_LIST(PLACES)}, lower(p)) AND NOT {_ANY_WORD('p')})"""


@query("people_pairs", f"WITH {DIARY_SQL} SELECT doc_id, idx, unnest({_NAMES_OF}) AS person FROM diary")
def people_pairs(read):
    return corpora.diary(read).select("doc_id", F.col("idx").cast("long").alias("idx"), F.explode(en.full_names(F.col("text"))).alias("person"))


@query("lone_names")
def lone_names(read):
    """First names alone in conversations' texts, by document."""
    said = read("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("text"))
    text = F.concat(F.lit("we saw Marita there. Then Marita said so. "), "text")
    return said.select("conv_id", F.explode(F.array_distinct(en.lone_names(text, en.places(text)))).alias("name"))


_FOUND = f"""{DIARY_SQL}, found AS (SELECT doc_id, idx, 'amount' AS kind, unnest(list_transform(regexp_extract_all(text, '{_AMOUNT}'), lambda x: trim(x))) AS value FROM diary
 UNION ALL SELECT doc_id, idx, 'place', unnest({_PLACES_OF}) FROM diary UNION ALL SELECT doc_id, idx, 'person', unnest({_NAMES_OF}) FROM diary)"""


FINDERS = {"amount": en.amounts, "place": en.places, "person": en.full_names}


def found_mentions(read, kinds=tuple(FINDERS)):
    """doc_id, idx, kind, value, pos of diary entries, each gone through once."""
    return en.found(corpora.diary(read), {k: FINDERS[k] for k in kinds})


@query("mention_tally", f"WITH {_FOUND} SELECT doc_id, kind, lower(value) AS key, count(*) AS n, count(DISTINCT idx) AS n_entries FROM found GROUP BY 1, 2, 3")
def mention_tally(read):
    t = en.tally(found_mentions(read))
    return t.select("doc_id", "kind", F.lower("value").alias("key"), F.col("count").alias("n"), F.size("entries").cast("long").alias("n_entries"))


_ACCEPTED = f"{_FOUND}, accepted AS (SELECT DISTINCT doc_id, kind, lower(value) AS key FROM found WHERE kind <> 'amount')"
_PRESENT = rf"{_ACCEPTED}, present AS (SELECT d.doc_id, d.idx, a.kind, a.key FROM diary d JOIN accepted a USING (doc_id) WHERE regexp_matches(lower(d.text), '\b' || replace(a.key, '.', '\.') || '\b'))"


def present_mentions(read):
    """Which accepted places and people each diary entry holds."""
    return en.accepted_in(corpora.diary(read), {"place": en.places, "person": en.full_names})


@query("mention_presence", f"WITH {_PRESENT} SELECT doc_id, kind, key, count(*) AS entry_count FROM present GROUP BY 1, 2, 3")
def mention_presence(read):
    p = present_mentions(read)
    return p.groupBy("doc_id", "kind", F.lower("value").alias("key")).agg(F.count("*").alias("entry_count"))


@query("said_once", f"WITH {_FOUND} SELECT kind, lower(value) AS key, count(*) AS documents FROM (SELECT doc_id, kind, lower(value) AS value, count(*) AS n FROM found GROUP BY 1, 2, 3) WHERE n = 1 GROUP BY 1, 2")
def said_once(read):
    """Values that a document has once, and in how many documents that is so."""
    t = en.tally(found_mentions(read)).filter("count = 1")
    return t.groupBy("kind", F.lower("value").alias("key")).agg(F.count("*").alias("documents"))


@query("mention_rollup", f"WITH {_FOUND} SELECT kind, lower(value) AS key, count(*) AS n FROM found WHERE kind <> 'amount' GROUP BY ROLLUP (kind, lower(value))")
def mention_rollup(read):
    rows = found_mentions(read, ("place", "person")).withColumn("key", F.lower("value"))
    return rows.rollup("kind", "key").agg(F.count("*").alias("n"))


@query("top_mentions", f"""WITH {_FOUND}, t AS (SELECT doc_id, kind, lower(value) AS key, count(*) AS n FROM found WHERE kind <> 'amount' GROUP BY 1, 2, 3)
SELECT doc_id, kind, key, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n DESC, key) AS rank FROM t) WHERE rank <= 3""")
def top_mentions(read):
    t = en.tally(found_mentions(read, ("place", "person")))
    top = en.top_mentions(t, {"place": 3, "person": 3})
    return top.select("doc_id", "kind", F.lower("value").alias("key"), F.col("count").alias("n"), F.col("rank").cast("long").alias("rank"))


@query("doc_stats", rf"""WITH {DIARY_SQL} SELECT doc_id, count(*) AS entries, count(date) AS dated_entries, count(month) AS placed_entries, count(month) - count(date) AS month_precision, count(DISTINCT month) AS months,
  sum(length(text))::BIGINT AS characters, sum(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}''’-]+')))::BIGINT AS words, arg_min(date, idx) FILTER (WHERE date IS NOT NULL) AS first_date, arg_max(date, idx) FILTER (WHERE date IS NOT NULL) AS last_date, min(date) AS min_date, max(date) AS max_date FROM diary GROUP BY doc_id""")
def doc_stats(read):
    return stats.document_stats(corpora.diary(read))


@query("entries_per_month", f"WITH {DIARY_SQL} SELECT doc_id, month, count(*) AS entries FROM diary WHERE month IS NOT NULL GROUP BY 1, 2")
def entries_per_month(read):
    return stats.entries_per_month(corpora.diary(read))


@query("term_facts", rf"""WITH {DIARY_SQL}, t AS (SELECT unnest(['boiler', 'grimsby', 'saw', 'fair']) AS term),
p AS (SELECT doc_id, idx, date, term, len(regexp_extract_all(lower(text), '\b' || term || '\w{{0,3}}\b')) AS n, regexp_matches(lower(text), '\b' || term) AS hit FROM diary, t)
SELECT doc_id, term, sum(n)::BIGINT AS occurrences, count(*) FILTER (WHERE hit) AS entry_hits, arg_min_null(date, idx) FILTER (WHERE hit) AS first_date, arg_max_null(date, idx) FILTER (WHERE hit) AS last_date FROM p GROUP BY 1, 2""")
def term_facts(read):
    d = corpora.diary(read)
    terms = d.sparkSession.sql("SELECT explode(array('boiler', 'grimsby', 'saw', 'fair')) AS term")
    return stats.term_counts(d, terms)


@query("month_compare", rf"""WITH {DIARY_SQL}, m AS (SELECT doc_id, month(date)::INT AS number, text FROM diary WHERE date IS NOT NULL AND month(date) IN (3, 4)),
w AS (SELECT doc_id, number, count(DISTINCT w) AS d FROM (SELECT doc_id, number, unnest(regexp_extract_all(lower(text), '[\p{{L}}'']{{4,}}')) AS w FROM m) GROUP BY 1, 2)
SELECT doc_id, number, count(*) AS entries, sum(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}''’-]+')))::BIGINT AS words, coalesce(any_value(d), 0) AS distinct_words FROM m LEFT JOIN w USING (doc_id, number) GROUP BY 1, 2""")
def month_compare(read):
    return stats.month_comparison(corpora.diary(read), [3, 4])


@query("first_last_dated", f"WITH {DIARY_SQL} SELECT doc_id, count(*) AS dated, arg_min(idx, idx) AS first_idx, arg_max(idx, idx) AS last_idx FROM diary WHERE date IS NOT NULL GROUP BY 1")
def first_last_dated(read):
    d = corpora.diary(read).filter("date IS NOT NULL")
    return d.groupBy("doc_id").agg(F.count("*").alias("dated"), F.min("idx").cast("long").alias("first_idx"), F.max("idx").cast("long").alias("last_idx"))


@query("image_pins", r"""WITH i AS (SELECT doc_id, 0 AS pos, 'u' || doc_id AS url, substr(text, 10, 60) AS caption FROM documents WHERE length(text) > 80), e AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS idx, unnest(string_split(text, chr(10))) AS text FROM documents),
h AS (SELECT i.doc_id, i.pos, min(e.idx) AS idx FROM i JOIN e USING (doc_id) WHERE contains(e.text, substr(i.caption, 1, 40)) GROUP BY 1, 2)
SELECT i.doc_id, i.url, coalesce(h.idx, -1) AS entry_idx FROM i LEFT JOIN h USING (doc_id, pos)""")
def image_pins(read):
    d = read("documents")
    images = d.filter("length(text) > 80").select("doc_id", F.lit(0).alias("pos"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.substring("text", 10, 60).alias("caption"))
    rows = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return en.pin_images(images, rows).select("doc_id", "url", F.col("entry_idx").cast("long").alias("entry_idx"))
