"""Queries of text normalisation and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..lexicons import ENTITIES, SECTION_WORDS
from ..operators import segment
from ..regex import quoted
from .registry import query

_TAG = r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|table|tr|td|span|img|a|section|article)\b"


def _decoded(sql: str) -> str:
    for name in [*(n for n in ENTITIES if n != "amp"), "amp"]:
        sql = f"regexp_replace({sql}, '&{name};', {quoted(ENTITIES[name])}, 'gi')"
    return sql


def _marked(sql: str) -> str:
    sql = rf"regexp_replace({sql}, '<img\b[^>]*>', ' [image] ', 'gi')"
    sql = rf"""regexp_replace({sql}, '!\[\]\(\s*[^)\s]+(?:\s+"[^"]*")?\s*\)', ' [image] ', 'g')"""
    return rf"""regexp_replace({sql}, '!\[([^\]]+)\]\(\s*[^)\s]+(?:\s+"[^"]*")?\s*\)', ' [image: \1] ', 'g')"""


def _stripped(sql: str) -> str:
    sql = rf"regexp_replace({sql}, '<!--.*?-->', ' ', 'gs')"
    # RE2 has no backreference, so each container has a step of its own
    for tag in ("script", "style", "noscript", "svg", "iframe", "template"):
        sql = rf"regexp_replace({sql}, '<{tag}\b[^>]*>.*?</{tag}>', ' ', 'gis')"
    sql = _marked(sql)
    steps = [(r"<br\s*/?>", "chr(10)"), (r"</(?:p|div|section|article|header|footer|li|tr|h[1-6]|blockquote|pre|figure)>", "chr(10) || chr(10)"), (r"<(?:li|tr)\b[^>]*>", "chr(10)"), (r"<h[1-6]\b[^>]*>", "chr(10) || chr(10)"), (r"<td\b[^>]*>", "' · '"), (r"<[^>]+>", "' '")]
    for pattern, by in steps:
        sql = f"regexp_replace({sql}, '{pattern}', {by}, 'gi')"
    return sql


def _spaced(sql: str) -> str:
    steps = [(r"\r\n?", "chr(10)"), (" ", "' '"), (r"[ \t]+\n", "chr(10)"), (r"[ \t]{2,}", "' '"), (r"\n{3,}", "chr(10) || chr(10)"), (r"[ \t\f\x0b]+(\n)", r"'\1'"), (r"[ \t\f\x0b]+$", "''"), (r"^\s+", "''"), (r"\s+$", "''")]
    for pattern, by in steps:
        sql = f"regexp_replace({sql}, '{pattern}', {by}, 'g')"
    return sql


PREPARED_SQL = f"SELECT page_id AS doc_id, {_spaced(_decoded(_stripped('html')))} AS text FROM pages"


def prepared(read):
    """Pages as plain text with named entities decoded."""
    return read("pages").select(F.col("page_id").alias("doc_id"), tx.normalise_space(tx.decode_named(tx.strip_html(F.col("html")))).alias("text"))


@query("html_sniff", rf"SELECT page_id, len(regexp_extract_all(substr(html, 1, 4000), '{_TAG}')) >= 3 AS is_html FROM pages")
def html_sniff(read):
    return read("pages").select("page_id", tx.looks_like_html(F.col("html")).alias("is_html"))


@query("entity_decode", f"SELECT page_id, {_decoded('html')} AS decoded FROM pages")
def entity_decode(read):
    return read("pages").select("page_id", tx.decode_named(F.col("html")).alias("decoded"))


@query("html_to_text", PREPARED_SQL)
def html_to_text(read):
    return prepared(read)


@query("normalise_ws", f"SELECT doc_id, {_spaced('text')} AS text FROM documents")
def normalise_ws(read):
    return read("documents").select("doc_id", tx.normalise_space(F.col("text")).alias("text"))


@query("image_markers", f"SELECT page_id, {_marked('html')} AS marked FROM pages")
def image_markers(read):
    return read("pages").select("page_id", tx.mark_images(F.col("html")).alias("marked"))


@query("title_guess", rf"""
WITH p AS ({PREPARED_SQL}), l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
  lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^#{{1,6}}\s+', '', 'g'), '^\*{{1,2}}|\*{{1,2}}$', '', 'g'))), lambda x: length(x) >= 3)[1] AS t FROM p)
SELECT doc_id, coalesce(CASE WHEN length(t) > 90 THEN substr(t, 1, 87) || '…' ELSE t END, 'Untitled document') AS title FROM l""")
def title_guess(read):
    return prepared(read).select("doc_id", tx.guess_title(F.col("text")).alias("title"))


@query("word_count", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}''’-]+')) AS words, length(text) AS characters FROM documents")
def word_count(read):
    return read("documents").select("doc_id", tx.count_words(F.col("text")).cast("long").alias("words"), F.length("text").cast("long").alias("characters"))


@query("fingerprint", "SELECT doc_id, sha256('9' || chr(0) || 'hash-64' || chr(0) || text) AS fingerprint FROM documents")
def fingerprint(read):
    return read("documents").select("doc_id", tx.fingerprint(F.col("text"), "hash-64").alias("fingerprint"))


@query("reuse_by_fingerprint", "WITH f AS (SELECT doc_id, sha256('9' || chr(0) || 'hash-64' || chr(0) || text) AS fingerprint FROM documents) SELECT fingerprint, count(*) AS copies, max(doc_id) AS newest FROM f GROUP BY 1 HAVING count(*) > 1")
def reuse_by_fingerprint(read):
    """The newest document of each content that was indexed more than once."""
    f = read("documents").select("doc_id", tx.fingerprint(F.col("text"), "hash-64").alias("fingerprint"))
    return f.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.max("doc_id").alias("newest")).filter("copies > 1")


@query("citation_marks", r"SELECT conv_id, turn, array_to_string(regexp_extract_all('as in [' || role || '] and [Entry ' || turn || ']: ' || text, '\[([^\[\]\n]{1,60})\]', 1), '|') AS labels FROM conversations")
def citation_marks(read):
    said = F.concat(F.lit("as in ["), "role", F.lit("] and [Entry "), F.col("turn").cast("string"), F.lit("]: "), "text")
    return read("conversations").select("conv_id", "turn", F.array_join(tx.citations(said), "|").alias("labels"))


# ---- segmentation over prepared pages (they have blank lines and headings) ----

_BLOCKS = rf"""
p AS ({PREPARED_SQL}), pieces AS (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS b, list_concat(regexp_extract_all(text, '\n\s*\n'), ['']) AS g FROM p),
placed AS (SELECT doc_id, unnest(b) AS text, unnest(range(len(b))) AS k, unnest(list_transform(range(len(b)), lambda i: coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0))) AS start FROM pieces),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, text, start::BIGINT AS start, (start + length(text))::BIGINT AS "end" FROM placed WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')
"""


@query("blocks", f'WITH {_BLOCKS} SELECT doc_id, pos, text, start, "end" FROM blocks')
def blocks(read):
    b = segment.blocks(prepared(read))
    return b.select("doc_id", F.col("pos").cast("long").alias("pos"), "text", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_LINES = f"""{_BLOCKS}, lines AS (SELECT doc_id, pos, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS text FROM blocks)"""


@query("lines", f"WITH {_LINES} SELECT doc_id, pos, line, text FROM lines")
def lines(read):
    x = segment.lines(segment.blocks(prepared(read)))
    return x.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("line").cast("long").alias("line"), "text")


_CANDIDATE = r"(v <> '' AND length(v) <= 80 AND NOT regexp_matches(v, '[.!?]$') AND (regexp_matches(v, '^#{1,6}\s+') OR (regexp_matches(v, '^[A-Z0-9][^.!?]*:?$') AND len(regexp_split_to_array(v, '\s+')) <= 10)))"


@query("heading_candidates", rf"""WITH {_LINES}, t AS (SELECT doc_id, pos, line, regexp_replace(text, '^\s+|\s+$', '', 'g') AS v FROM lines),
j AS (SELECT *, lead(v) OVER (PARTITION BY doc_id ORDER BY pos, line) AS nxt FROM t)
SELECT doc_id, pos, line, regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '^#{{1,6}}\s+', '', 'g'), '^\*\*|\*\*$', '', 'g'), ':$', '', 'g'), '^\s+|\s+$', '', 'g') AS heading,
  coalesce(regexp_matches(nxt, '[.!?]$'), false) AS confirmed FROM j WHERE {_CANDIDATE}""")
def heading_candidates(read):
    from pyspark.sql import Window

    x = segment.lines(segment.blocks(prepared(read)))
    x = x.withColumn("next", F.lead("text").over(Window.partitionBy("doc_id").orderBy("pos", "line"))).filter(tx.is_heading_candidate(F.col("text")))
    return x.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("line").cast("long").alias("line"), tx.clean_heading(F.col("text")).alias("heading"), tx.ends_sentence(F.col("next")).alias("confirmed"))


_HEADS = [w.title() for w in SECTION_WORDS[::3]] + ["Work model: Hybrid", "PROFESSIONAL EXPERIENCE", "Core Stack", "SUMMARY OF TERMS AND ALL", "The skills that we have here now", "A policy", "Some other line", "my Education", ""]
_WORDS_SQL = "[" + ", ".join(quoted(w) for w in SECTION_WORDS) + "]"


_SECTIONS = rf"""w AS (SELECT line, list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace(line, '^\s+|\s+$', '', 'g')), '[^a-z\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS w FROM h)
SELECT line, NOT contains(line, ':') AND len(w) BETWEEN 1 AND 4 AND coalesce(list_contains({_WORDS_SQL}, w[1]) OR (len(w) <= 2 AND list_has_any({_WORDS_SQL}, w)), false) AS is_section FROM w"""


@query("section_names", rf"""WITH l AS (SELECT * FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT text FROM conversations) WHERE line IS NOT NULL), k AS (SELECT DISTINCT line, hash_key FROM (SELECT line, length(line) % {len(_HEADS)} AS hash_key FROM l)),
h AS (SELECT line FROM k UNION SELECT ([{", ".join(quoted(h) for h in _HEADS)}])[hash_key + 1] || CASE WHEN length(line) % 3 = 0 THEN '' ELSE ' ' || split_part(line, ' ', 1) END FROM k), {_SECTIONS}""")
def section_names(read):
    """Which lines of documents and conversations name a section, and which headings with a word of these lines behind them do."""
    rows = read("documents").select(F.explode(F.split("text", "\n")).alias("line")).union(read("conversations").select("text")).distinct()
    head = F.get(F.array(*[F.lit(h) for h in _HEADS]), (F.length("line") % len(_HEADS)).cast("int"))
    more = F.when(F.length("line") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.split_part("line", F.lit(" "), F.lit(1))))
    lines = rows.filter("line IS NOT NULL").union(rows.filter("line IS NOT NULL").select(F.concat(head, more))).distinct()
    return lines.select("line", tx.is_section_name(F.col("line")).alias("is_section"))


@query("line_run_groups", r"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island, regexp_matches(line, '^\s*$') AS blank FROM l),
n AS (SELECT doc_id, i, island, count(*) OVER (PARTITION BY doc_id, island) AS n, row_number() OVER (PARTITION BY doc_id, island ORDER BY i) - 1 AS place FROM f WHERE NOT blank)
SELECT doc_id, n, CASE WHEN n >= 12 THEN (place // ceil(n / ceil(n / 10.0))::BIGINT) ELSE 0 END AS piece, count(*) AS lines FROM n GROUP BY doc_id, island, n, piece""")
def line_run_groups(read):
    """How many lines each group of each run of lines has."""
    n = segment.line_runs(read("documents"))
    return n.groupBy("doc_id", "island", "n", "piece").agg(F.count("*").alias("lines")).select("doc_id", "n", "piece", "lines")


@query("entries")
def entries(read):
    """Entries of prepared pages, with their date fields."""
    return segment.entries(prepared(read))


@query("entries_lossless", f"WITH {_BLOCKS} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM blocks GROUP BY 1")
def entries_lossless(read):
    """Entries joined again are the blocks of the page."""
    from ..sources.store import document_text

    return document_text(segment.entries(prepared(read), dated=False))


@query("notes")
def notes(read):
    """Search notes of all documents."""
    return segment.notes(segment.entries(read("documents").select("doc_id", "text")))


@query("notes_within_window", rf"""WITH w AS (SELECT doc_id, regexp_extract_all(replace(text, '_', ' '), '[\p{{L}}\p{{N}}''’-]+') AS w FROM documents)
SELECT doc_id, len(list_distinct(w)) AS words, len(w) <= {segment.WINDOW} AS one_window, true AS fits FROM w WHERE len(w) > 0""")
def notes_within_window(read):
    """Notes of a document have all its words, none has more than a window and its reach, and short documents are one stretch of words."""
    n = segment.notes(segment.entries(read("documents").select("doc_id", "text")))
    words = F.regexp_extract_all(F.replace("text", F.lit("_"), F.lit(" ")), F.lit(r"[\p{L}\p{N}'’-]+"), F.lit(0))
    # notes are made once; of each, its different words are all that is shuffled
    own = F.size(F.array_distinct(F.flatten(F.collect_list("w")))).cast("long")
    per = n.select("doc_id", "words", F.array_distinct(words).alias("w")).groupBy("doc_id").agg(own.alias("different"), F.sum("words").alias("held"), F.max("words").alias("longest"))
    both = per.filter("different > 0").withColumn("words", F.col("different"))
    return both.select("doc_id", "words", (F.col("held") <= segment.WINDOW).alias("one_window"), (F.col("longest") <= segment.WINDOW + segment.REACH).alias("fits"))


@query("searchable_text", f"WITH p AS ({PREPARED_SQL}), t AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS h FROM p) SELECT doc_id, CASE WHEN h IS NULL OR starts_with(text, CASE WHEN doc_id % 2 = 0 THEN h ELSE 'Page ' || doc_id END) THEN text ELSE 'Page ' || doc_id || chr(10) || text END AS searchable FROM t")
def searchable_text(read):
    p = prepared(read)
    head = F.when(F.col("doc_id") % 2 == 0, F.get(F.split("text", "\n"), F.lit(0))).otherwise(F.concat(F.lit("Page "), F.col("doc_id").cast("string")))
    return p.select("doc_id", tx.searchable(head, F.col("text")).alias("searchable"))


@query("image_references")
def image_references(read):
    """Pictures of pages and of made-up text around them, in document order."""
    html = F.concat("html", F.lit('<p>![chart](http://a.example/c.png "t") and http://a.example/c.png, //x.example/y.gif</p><img alt="A &amp; B" src=\'/z.jpg\'>'))
    rows = read("pages").select("page_id", F.posexplode(tx.images(html)).alias("pos", "i"))
    return rows.select("page_id", "pos", "i.url", "i.caption")


@query("stack_frames", r"""
WITH s AS (SELECT event_id, 'at f' || (event_id % 7) || ' (http://x.example/a.js?v=' || event_id || ':' || user_id || ':' || (event_id % 90) || ')' AS line FROM events)
SELECT event_id, regexp_extract(line, '\((.*):([0-9]+):([0-9]+)\)$', 1) AS filename, regexp_extract(line, '\((.*):([0-9]+):([0-9]+)\)$', 2)::INT AS lineno, regexp_extract(line, '\((.*):([0-9]+):([0-9]+)\)$', 3)::INT AS colno, regexp_extract(line, '^at (.*) \(', 1) AS method FROM s""")
def stack_frames(read):
    e = read("events")
    s = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("Error: x\n   at f"), (F.col("event_id") % 7).cast("string"), F.lit(" (http://x.example/a.js?v="), s("event_id"), F.lit(":"), s("user_id"), F.lit(":"), (F.col("event_id") % 90).cast("string"), F.lit(")\nnoise"))
    return e.select("event_id", F.explode(tx.stack_frames(line)).alias("f")).select("event_id", "f.filename", "f.lineno", "f.colno", "f.method")


@query("redact_text", r"""
SELECT page_id, substr('failed at ' || regexp_replace(regexp_replace(url, '[?#].*$', '', 'g'), '\s+', ' ', 'g') || ' (see /p/' || page_id || ')', 1, 300) AS message FROM pages""")
def redact_text(read):
    said = F.concat(F.lit("failed   at "), "url", F.lit(" (see /p/"), F.col("page_id").cast("string"), F.lit("?token=1)"))
    return read("pages").select("page_id", tx.redact_urls(said, 300).alias("message"))
