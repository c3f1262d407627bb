"""Personal data: base patterns, and more spans by boosted trees over candidates.

Base spans of four kinds follow fixed patterns and always count. Beside them,
high-recall generators propose overlapping candidates (numbers in other
groupings, disguised addresses); gradient-boosted trees over format and context
features give each a calibrated probability, and those over the threshold that
clash with no base span and no better candidate are added.

All of it is one projection: matches and their places come from extracting and
splitting by the same pattern, trees are CASE expressions. Texts without any
digit or @, and without a disguised @, skip every pattern. Patterns are possessive,
places are running totals, contexts are cut from the chunks of a text, and overlaps are
counted along sorted events, so that texts of any length and with any number of
matches take near linear time. Generators are as wide as the formats: a disguised address
has 64 characters before its sign and 63 a label at most, a number 19 digits (base
spans have no such bounds). Of candidates that tie, the one of least place, end, kind stays.

Null text is empty and has no spans. Repeated rows get repeated results; an
empty table gives an empty result; find() ignores extra columns, redact() keeps
them. Places are code points from 0, ends exclusive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, boost, calibrate, threshold_for
from .common import let, sql_literal, table

KINDS = ("email", "ip", "card", "phone")
#: Equal to the leftmost matches of the base patterns, without backtracking over long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"\x20?(?:\[at\]|\(at\)|\{at\}|\x20at\x20|@)\x20?"
_DOT = r"\x20?(?:\[dot\]|\(dot\)|\{dot\}|\x20dot\x20|\.)\x20?"
#: (kind, pattern): more candidates than are right.
GENERATORS = [
    ("email", rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}{_AT}[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{1,63}}){{1,4}}"),
    ("ip", r"(?<![0-9])[0-9]{1,3}(?:\x20?[\[(]?\.[\])]?\x20?[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"(?<![0-9])(?:[0-9]{4}[\x20./-]){3}[0-9]{4}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}[\x20.-][0-9]{6}[\x20.-][0-9]{5}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])00[1-9][\x20().0-9-]{6,20}[0-9](?![0-9])"),
]
CONTEXT = 32
PRECISION = 0.95
#: Elements that one fold may copy at each step; code points of a chunk of a text; pairs compared one by one.
BLOCK = 64
CHUNK = 256
FEW_PAIRS = 1024
FEATURES = ("kind", "digits", "luhn", "length", "groups", "joined_before", "joined_after", "near_word", "other_word", "different_digits", "card_prefix", "octets", "known_end", "disguised", "bracketed", "spaced_dot", "signed")
_NEAR = {
    "email": r"mail|contact|write|reach|address|correo|adresse",
    "ip": r"\bip\b|host|server|address|login|client|adresse",
    "card": r"card|visa|credit|debit|pay|carte|karte|tarjeta|amex|master",
    "phone": r"phone|tel|call|fax|mobile|cell|ring|anruf|handy|appel|llam",
}
_OTHER = r"order|invoice|version|isbn|serial|part|sku|ref|build|rev|chapter|section|model|tracking|batch|room|page|item|id\b|no\.|#"
_ENDS = r"(?i)\b(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"


def running(values: Column, op=lambda a, b: a + b) -> Column:
    """The running totals of an array of ints by an associative op.

    Totals within blocks, then of the blocks: a fold that copies its array at each step
    is quadratic, but short here.
    """

    def scan(xs: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            to = F.when(a["at"].isNull(), x).otherwise(op(a["at"], x))
            return F.struct(to.alias("at"), F.concat(a["out"], F.array(to)).alias("out"))

        return F.aggregate(xs, F.struct(F.lit(None).cast("int").alias("at"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])

    def blocked(xs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK))

        def spread(blocks: Column) -> Column:
            totals = scan(F.transform(blocks, lambda b: F.element_at(b, -1)))
            return let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: op(F.get(t, i - 1), x))))))

        return let(F.transform(starts, lambda i: scan(F.slice(xs, i, F.lit(BLOCK)))), spread)

    return let(values, lambda xs: F.when(F.size(xs) <= BLOCK, scan(xs)).otherwise(blocked(xs)))


def chunks_of(text: Column) -> Column:
    """The text in pieces of CHUNK code points, in which between() finds a place at once."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of the text that was cut into chunks."""
    first = F.floor(start / CHUNK).cast("int")
    held = F.slice(chunks, first + 1, F.floor((end - 1) / CHUNK).cast("int") - first + 1)
    return F.when(end > start, F.substring(F.array_join(held, ""), start - first * CHUNK + 1, end - start)).otherwise(F.lit(""))


def _all(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """array of (kind, start, end, value): all matches of each pattern (kind, pattern) in turn, leftmost and non-overlapping.

    What the patterns find is placed by one expression for all: the plan grows by little with each.
    """

    def found(kind: str, pattern: str) -> Column:
        apart = lambda values: F.struct(F.lit(KINDS.index(kind)).alias("kind"), values.alias("values"), F.split(text, pattern, -1).alias("around"))
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: F.when(F.size(values) > 0, apart(values)))

    def places(m: Column) -> Column:
        ends = running(F.zip_with(F.slice(m["around"], F.lit(1), F.size(m["values"])), m["values"], lambda b, v: F.length(b) + F.length(v)))
        return F.zip_with(ends, m["values"], lambda e, v: F.struct(m["kind"].alias("kind"), (e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))

    return F.flatten(F.transform(F.filter(F.array(*[found(k, p) for k, p in patterns]), lambda m: m.isNotNull()), places))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def doubled(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), doubled), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def _octets(value: Column) -> Column:
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return value.rlike(rf"^{byte}(?:[^0-9]+{byte}){{3}}$")


def _valid(m: Column) -> Column:
    """Whether a match of a base pattern holds what its kind must."""
    card = let(digits_of(m["value"]), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    phone = F.length(digits_of(m["value"])).between(8, 15)
    kind = m["kind"]
    return F.when(kind == KINDS.index("email"), F.lit(True)).when(kind == KINDS.index("ip"), _octets(m["value"])).when(kind == KINDS.index("card"), card).otherwise(phone)


def base_spans(text: Column) -> Column:
    """array of (kind, start, end, value) in the order of kinds, then places."""
    return F.filter(_all(text, [(k, BASE[k]) for k in KINDS]), _valid)


def candidates(text: Column) -> Column:
    """All that the generators propose, overlaps and base spans included."""
    return _all(text, GENERATORS)


def features(chunks: Column, c: Column) -> Column:
    """A struct of FEATURES of candidate c (kind, start, end, value) in a text cut into chunks."""

    def described(x: Column) -> Column:
        value, before, after, digits = c["value"], x["before"], x["after"], x["digits"]
        near = F.lit(False)
        for k, kind in enumerate(KINDS):
            near = near | ((c["kind"] == k) & before.rlike(_NEAR[kind]))
        flags = {
            "kind": c["kind"], "digits": F.length(digits), "luhn": (F.length(digits) > 11) & luhn(digits), "length": F.length(value),
            "groups": F.size(F.split(value, "[^0-9A-Za-z]+")), "joined_before": before.rlike("[A-Za-z0-9._/+-]$"), "joined_after": after.rlike("[A-Za-z0-9_/-]"),
            "near_word": near, "other_word": before.rlike(_OTHER), "different_digits": F.size(F.array_distinct(F.split(digits, ""))),
            "card_prefix": digits.rlike("^[3-6]"), "octets": _octets(value), "known_end": value.rlike(_ENDS), "disguised": value.rlike(r"(?i)\Wat\W|\Wdot\W"), "spaced_dot": value.rlike(r"\.\x20"), "bracketed": value.rlike(r"(?i)[\[({]at[\])}]"), "signed": before.rlike(r"\+$"),
        }
        return F.struct(*[flags[f].cast("double").alias(f) for f in FEATURES])

    before = F.lower(between(chunks, F.greatest(c["start"] - CONTEXT, F.lit(0)), c["start"]))
    return let(F.struct(before.alias("before"), between(chunks, c["end"], c["end"] + 1).alias("after"), digits_of(c["value"]).alias("digits")), described)


def training_table() -> list[tuple[str, str]]:
    """(text, the personal data in it or ''), made by rule; numbers follow a fixed recurrence."""
    state = [12345]

    def draw(n: int) -> int:
        state[0] = (state[0] * 1103515245 + 12345) % 2**31
        return (state[0] >> 8) % n

    def number(n: int) -> str:
        return str(1 + draw(9)) + "".join(str(draw(10)) for _ in range(n - 1))

    def card(n: int, right: bool) -> str:
        body = "345"[draw(3)] + number(n - 2)
        for check in map(str, range(10)):
            total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(body + check))))
            if (total % 10 == 0) == right:
                return body + check
        raise AssertionError

    def grouped(d: str, sep: str) -> str:
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))

    words = "the and lorem with ipsum over dolor under sit then amet here quia not vel more".split()
    some = lambda: " ".join(words[draw(len(words))] for _ in range(2 + draw(4)))
    rows = []
    for _ in range(20):
        octet = [str(draw(256)) for _ in range(4)]
        host = words[draw(16)]
        for at, dot in (("@", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), ("{at}", "{dot}"), (" (at) ", " (dot) ")):
            name = words[draw(16)] + ["", number(2), "." + words[draw(16)], "_" + number(1), "-" + words[draw(16)]][draw(5)]
            lead = [f"{some()} mail {some()}", f"{some()} contact", some()][draw(3)]
            rows.append((lead, f"{name}{at}{host}{dot}{['com', 'org', 'net', 'de', 'info', 'fr'][draw(6)]}"))
        rows += [(f"{some()} look at {host}.{words[draw(16)]} {some()}", ""), (f"{some()} meet at noon. Then {some()}", ""), (f"{some()} stay at {words[draw(16)]}. {['Com', 'Org', 'Net', 'De', 'Info', 'Fr'][draw(6)]} {some()}", "")]
        rows += [(f"{some()} server ", "[.]".join(octet)), (f"{some()} host ip ", "(.)".join(octet)), (f"{some()}", ".".join(octet))]
        rows += [(f"version {'.'.join(str(300 + draw(600)) for _ in range(4))} {some()}", ""), (f"section {draw(9)} . {draw(9)} . {draw(9)} . {draw(9)} {some()}", "")]
        for n in (13, 15, 16, 16, 19):
            rows += [(f"{some()} card ", card(n, True)), (f"{some()}", card(n, True)), (f"{some()} order {card(n, False)} {some()}", ""), (f"{some()} {card(n, False)} {some()}", "")]
        for sep in (" ", ".", "-", "/"):
            rows += [(f"{some()} visa ", grouped(card(16, True), sep)), (f"{some()}", grouped(card(16, True), sep)), (f"{some()} serial {grouped(card(16, False), sep)}", "")]
        area, first, last = number(3), number(3), number(4)
        for shape in ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"):
            rows += [(f"{some()} call ", shape.format(area, first, last)), (f"{some()} tel ", shape.format("0" + number(2), first, last)), (f"{some()} invoice {shape.format(area, first, last)}", ""), (f"{some()} part no. {shape.format(area, first, last)} {some()}", "")]
        rows += [(f"{some()} phone ", f"00{number(2)} {number(3)} {number(6)}"), (f"{some()} ({area}) {number(3)}{number(3)} {some()}", ""), (f"{some()} {draw(9)}{number(3)}-0{1 + draw(9)}-{10 + draw(18)} {some()}", "")]
    return rows


_fitted: list[tuple[Boosted, list[float]]] = []


def described(rows: DataFrame) -> DataFrame:
    """rows (k, text, truth) by candidate: k, truth, kind, value, f (features), y: 1 if it is the truth."""
    each = rows.select("k", "text", "truth", chunks_of(F.col("text")).alias("chunks"), candidates(F.col("text")).alias("found")).select("k", "truth", "chunks", F.explode("found").alias("c"))
    return each.select("k", "truth", "c.kind", "c.value", features(F.col("chunks"), F.col("c")).alias("f"), (F.col("c.value") == F.col("truth")).cast("int").alias("y"))


def fitted(spark: SparkSession) -> tuple[Boosted, list[float]]:
    """The model and the threshold of each kind, trained once a process on training_table().

    The same expressions as in find() propose and describe its candidates. Trees are
    fitted on half of the texts, calibrated and thresholded on the others.
    """
    if _fitted:
        return _fitted[0]
    values = ", ".join(f"({k}, {sql_literal(text + ('' if not truth else ' ' if text[-1:] != ' ' else '') + truth)}, {sql_literal(truth)})" for k, (text, truth) in enumerate(training_table()))
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS t(k, text, truth)")
    taught = described(rows).filter("y = 1 OR NOT contains(truth, value)")  # a part of the truth is no mistake
    data = sorted((r.k, tuple(r.f), r.y, r.kind) for r in taught.collect())  # as many rows as the fixed table proposes
    k, x, y, kind = (np.array([d[j] for d in data], t) for j, t in ((0, int), (1, float), (2, float), (3, int)))
    held = k % 2 == 1
    model = calibrate(boost(x[~held], y[~held]), x[held], y[held])
    _fitted.append((model, [threshold_for(model.probability(x[held & (kind == j)]), y[held & (kind == j)], PRECISION) for j in range(len(KINDS))]))
    return _fitted[0]


def overlapped(found: Column, spans: Column) -> Column:
    """array of booleans: whether each of `found` (start, end) overlaps any of `spans`.

    The spans that start before an end, less those that end by a start. Both are counted
    along sorted events; a few pairs are compared directly.
    """

    def one_by_one(c: Column) -> Column:
        return F.exists(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))

    def counted(at_span: str, at_found: str, spans_first: bool) -> Column:
        event = lambda at, first, add, i: F.struct(at.alias("at"), F.lit(0 if first else 1).alias("order"), F.lit(add).alias("add"), i.alias("i"))
        mine = F.transform(found, lambda c, i: event(c[at_found], not spans_first, 0, i))
        events = F.array_sort(F.concat(mine, F.transform(spans, lambda s: event(s[at_span], spans_first, 1, F.lit(-1)))))

        def numbers(e: Column) -> Column:
            each = F.zip_with(running(F.transform(e, lambda x: x["add"])), e, lambda n, x: F.struct(x["i"].alias("i"), n.alias("n")))
            return F.transform(F.array_sort(F.filter(each, lambda x: x["i"] >= 0)), lambda x: x["n"])

        return let(events, numbers)

    along = F.zip_with(counted("start", "end", False), counted("end", "start", True), lambda a, b: a > b)
    return F.when(F.size(found) * F.size(spans) <= FEW_PAIRS, F.transform(found, one_by_one)).otherwise(along)


def not_overlapping(found: Column) -> Column:
    """Of overlapping (order, start, end, ...) the one of least order stays, and so on; the rest in order of place.

    Candidates are compared within a run of overlapping ones only.
    """

    def pick(own: Column) -> Column:
        def step(kept: Column, c: Column) -> Column:
            return F.when(F.exists(kept, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])), kept).otherwise(F.concat(kept, F.array(c)))

        return F.aggregate(F.array_sort(own), F.slice(own, F.lit(1), F.lit(0)), step)

    def runs(x: Column) -> Column:
        own = F.transform(x["firsts"], lambda f, j: F.slice(x["placed"], f + 1, F.coalesce(F.get(x["firsts"], j + 1), F.size(x["placed"])) - f))
        return F.flatten(F.transform(own, lambda c: F.when(F.size(c) == 1, c).otherwise(pick(c))))

    def placed(p: Column) -> Column:
        return let(F.struct(p.alias("placed"), first_of_runs(p).alias("firsts")), runs)

    by_place = F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], a["end"] - b["end"]).otherwise(a["kind"] - b["kind"]))
    chosen = F.transform(let(by_place, placed), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["value"].alias("value")))
    return F.when(F.size(found) > 0, F.array_sort(chosen)).otherwise(F.slice(chosen, F.lit(1), F.lit(0)))


def first_of_runs(spans: Column) -> Column:
    """Indices of the spans, in order of start, that overlap none before them."""

    def of(ends: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(ends, i - 1)))

    return let(running(F.transform(spans, lambda s: s["end"]), F.greatest), of)


def _added(text: Column, base: Column, found: Column, model: Boosted, thresholds: list[float]) -> Column:
    """Candidates (found) over their kind's threshold that overlap no base span; of overlapping ones the most probable stays."""

    def scored(chunks: Column, c: Column) -> Column:
        p = let(features(chunks, c), lambda f: model.column(lambda k: f[FEATURES[k]]))
        return F.struct((-p).alias("order"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["value"].alias("value"))

    def judged(clear: Column) -> Column:
        least = F.array(*[F.lit(t) for t in thresholds])
        every = let(chunks_of(text), lambda chunks: F.transform(clear, lambda c: scored(chunks, c)))
        return let(F.filter(every, lambda c: -c["order"] >= F.get(least, c["kind"])), not_overlapping)

    marked = F.zip_with(found, overlapped(found, base), lambda c, o: F.struct(c.alias("c"), o.alias("o")))
    clear = F.transform(F.filter(marked, lambda m: ~m["o"]), lambda m: m["c"])
    in_order = lambda spans: F.transform(spans, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value")))
    chosen = let(clear, lambda x: F.when(F.size(x) > 0, in_order(judged(x))))
    return F.when(F.size(found) > 0, chosen)


#: A text without any of these has no candidate: numbers need a digit, and addresses one of _AT, of which
#: the plain word is too frequent and needs what must follow it as well.
_HINT = rf"[0-9@]|(?i:[\[({{]at[\])}}]|\x20at\x20\x20?[a-z0-9-]{{1,63}}{_DOT}[a-z0-9-])"
_SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"


_built: dict[str, tuple[Column, Column, Column]] = {}


def with_spans(rows: DataFrame, text: Column, hinted: bool = True) -> DataFrame:
    """rows with base and added: arrays of (kind, start, end, value) in the text, empty ones for a null.

    Three projections, each over the columns of the one before: texts that can hold anything (all,
    if not hinted), what patterns find in them, and what the model adds. So each is planned by
    itself, and its expressions, which Python takes seconds to put together, are built once a JVM.
    """
    spark = rows.sparkSession
    key = spark.sparkContext.applicationId
    if key not in _built:
        model, thresholds = fitted(spark)
        own, base, found = (F.col(c) for c in ("_text", "_base", "_found"))
        _built[key] = (base_spans(own), candidates(own), _added(own, base, found, model, thresholds))
    base, found, added = _built[key]
    none = F.array().cast(_SPANS)
    cut = rows.withColumn("_text", F.when(text.rlike(_HINT) if hinted else text.isNotNull(), text))
    proposed = cut.select("*", base.alias("_base"), found.alias("_found"))
    return proposed.select(*rows.columns, F.coalesce("_base", none).alias("base"), F.coalesce(added, none).alias("added"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, added: arrays of (kind, start, end, value) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_spans(rows, F.col("text")).select("doc_id", "base", "added")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans (one at least) replaced by its first span's kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def joined(x: Column) -> Column:
        # where the run before ends: nothing of it reaches beyond
        after = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(x["ends"], F.get(x["firsts"], j) - 1))
        parts = F.transform(x["firsts"], lambda f, j: F.concat(between(x["chunks"], after(j), F.get(x["spans"], f)["start"]), F.get(names, F.get(x["spans"], f)["kind"])))
        return F.concat(F.array_join(parts, ""), between(x["chunks"], F.element_at(x["ends"], -1), x["length"]))

    def measured(s: Column) -> Column:
        ends = running(F.transform(s, lambda x: x["end"]), F.greatest)
        return let(F.struct(s.alias("spans"), ends.alias("ends"), first_of_runs(s).alias("firsts"), chunks_of(text).alias("chunks"), F.length(text).alias("length")), joined)

    return let(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), measured)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with personal data replaced by its kind; a column of lengths, if there is one, follows the text."""
    text = F.col(f"row.`{text_col}`")
    held = with_spans(docs.select(F.struct("*").alias("row")), text).select("row", F.concat("base", "added").alias("all"))
    clean = F.when(F.size("all") > 0, redacted(text, F.col("all"))).otherwise(text)
    held = held.select("row", "all", clean.alias("clean"))
    changed = {text_col: F.col("clean")}
    if chars_col in docs.columns:
        changed[chars_col] = F.when(F.size("all") > 0, F.length("clean")).otherwise(F.col(f"row.{chars_col}")).cast(docs.schema[chars_col].dataType)
    return held.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def listed(spans: Column) -> Column:
    """kind:start:end by kind, then start, joined by commas."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(KINDS.index(k)))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
