"""Quality rules: one projection compiled from a table of thresholds.

Measures of a text (lengths, symbols, stop words, lines, repeats) are columns;
each rule is a row (name, measure, least, most) and all of them become one
boolean projection. There is no shuffle, no join and no user function.

Null text has no words and fails the length rule. Measures that divide by a
number of words or lines are 0 for texts without any. Repeated rows are judged
alike, extra columns ignored or kept as asked, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, table, text_or_empty

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
a an and are as at be by for from in is it of on or that the this to was were with not have has
au aux avec ce ces dans de des du elle en est et il la le les ou par pas pour qui que sur un une
als auf das dem den der des die ein eine im in ist mit nicht sich sie und von zu für
al como con del el en es la las lo los no para por que se su un una y
""".split()

#: (rule, measure, least, most); a measure outside fails the document.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("enough_words", "n_words", 10, None),
    ("few_repeats", "repeat_percent", None, 20),
    ("mean_word_length", "mean_word_length", 2, 14),
    ("few_symbols", "symbol_ratio", None, 0.25),
    ("stop_words", "stop_ratio", 0.02, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.5),
    ("few_shouts", "upper_ratio", None, 0.6),
]
#: Rules that stand by contract; the others are this method's own.
BASE_RULES = ("enough_words", "few_repeats")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in a window of `window` words that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - 1)
        pairs = F.array_sort(F.arrays_zip(hashes.alias("h"), at.alias("at")))

        def spread(ordered: Column) -> Column:
            twice = F.filter(ordered, lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)))
            starts = F.array_sort(F.transform(twice, lambda x: x["at"]))

            def total(s: Column) -> Column:
                steps = F.transform(s, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(s, i + 1) - x, F.lit(window))))
                return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

            return let(starts, total)

        return let(pairs, spread)

    def of_words(w: Column) -> Column:
        n = F.size(w) - (window - 1)
        hashed = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])))
        return let(hashed, lambda h: F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(covered(h)))

    return let(words, of_words).cast("long")


def measures(text: Column) -> Column:
    """A struct of all measures of a text that isn't null."""

    def of_words(w: Column) -> Column:
        n = F.size(w).cast("long")
        chars = F.length(F.array_join(w, "")).cast("long")
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

        def of_lines(x: Column) -> Column:
            return F.struct(F.size(x).cast("long").alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

        stops = F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long")
        upper = F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long")
        letters = F.regexp_count(text, F.lit(r"\p{L}")).cast("long")
        return F.struct(
            n.alias("n_words"), chars.alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, of_lines).alias("line"), repeated_words(w).alias("n_repeat_words"), stops.alias("n_stop_words"), upper.alias("n_upper"), letters.alias("n_letters"),
        )

    return let(words_of(text), of_words)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=tuple(RULES), base=BASE_RULES) -> DataFrame:
    """Measures and verdicts: doc_id, counts, ratios, failed (names of rules), base_failed, kept."""
    m = docs.select(F.col(id_col).alias("doc_id"), measures(text_or_empty(text_col)).alias("m"))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n = F.col("m.n_words")
    counted = m.select(
        "doc_id", n.alias("n_words"), "m.word_chars", "m.n_symbols", F.col("m.line.dup").alias("n_dup_lines"), "m.n_repeat_words", "m.n_stop_words",
        per(100 * F.col("m.n_repeat_words"), n).alias("repeat_percent"), per(F.col("m.word_chars"), n).alias("mean_word_length"),
        per(F.col("m.n_symbols"), F.col("m.word_chars")).alias("symbol_ratio"), per(F.col("m.n_stop_words"), n).alias("stop_ratio"),
        per(F.col("m.line.dup"), F.col("m.line.lines")).alias("dup_line_ratio"), per(F.col("m.n_upper"), F.col("m.n_letters")).alias("upper_ratio"),
    )

    def broken(measure: str, least: float | None, most: float | None) -> Column:
        low = F.col(measure) < least if least is not None else F.lit(False)
        return low | (F.col(measure) > most) if most is not None else low

    fails = {name: broken(measure, least, most) for name, measure, least, most in rules}
    some = lambda names: F.array_compact(F.array(*[F.when(fails[x], F.lit(x)) for x in names]))
    failed = counted.withColumns({"failed": some(fails), "base_failed": F.size(some([x for x in fails if x in base])) > 0})
    return failed.withColumn("kept", F.size("failed") == 0)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    # the contract compares whole numbers, so that no rounding of a ratio counts
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"))


def _sql() -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))) + "]"
    per = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / {b} ELSE 0.0 END"
    measured = {
        "n_words": "n_words", "repeat_percent": per("100 * n_repeat_words", "n_words"), "mean_word_length": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "word_chars"),
        "stop_ratio": per("n_stop", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "upper_ratio": per("n_upper", "n_letters"),
    }
    broken = " OR ".join(f"({measured[m]}) {op} {bound}" for _, m, low, high in RULES for op, bound in (("<", low), (">", high)) if bound is not None)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT n, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT n, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS k FROM (SELECT n, words, unnest(range(1, greatest(len(words) - {WINDOW - 2}, 1))) AS i FROM w)),
c AS (SELECT n, i, count(*) OVER (PARTITION BY n, k) AS times FROM g),
s AS (SELECT n, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY n ORDER BY i) - i, {WINDOW})) AS step FROM c WHERE times > 1),
r AS (SELECT n, sum(step)::BIGINT AS n_repeat_words FROM s GROUP BY n),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(words, lambda x: list_contains({stop}, lower(x)))) AS n_stop,
  len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '\p{{L}}')) AS n_letters FROM w LEFT JOIN r USING (n))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT ({broken}) AS kept FROM m
"""


OP8_SQL = _sql()
