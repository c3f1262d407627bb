"""Around an answer: what it was written from, the prompt, the reply, and its reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed

REFUSAL = "The document doesn't say."
_SECOND = r"WHAT (?:IT|THE DOCUMENT|THE DIARY) SUGGESTS"
_FIRST = r"(?:WHAT THE (?:DOCUMENT|DIARY) SAYS|THE DOCUMENT SAYS)"
LABELS, TOP = 12, 12


def details(shown: DataFrame) -> DataFrame:
    """question_id, labels (distinct, in rank order), dates (sorted, those without last), first_date, last_date, notes.

    shown: question_id, rank, label, date.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "label")))
    dates = F.array_sort(F.collect_set("date"))
    rows = shown.groupBy("question_id").agg(ordered.alias("l"), dates.alias("d"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("notes"))
    return rows.select("question_id", F.slice(F.array_distinct(F.transform("l", lambda x: x["label"])), 1, LABELS).alias("labels"), F.col("d").alias("dates"), "first_date", "last_date", "notes")


def tallies(shown: DataFrame, top: int = TOP) -> DataFrame:
    """question_id, kind, value as first written, notes, rank: places, people, amounts and images of the shown notes, the most frequent first.

    shown: question_id, rank, and the arrays places, people, amounts, images.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(F.col(c)).alias("values")) for k, c in (("place", "places"), ("person", "people"), ("amount", "amounts"), ("image", "images"))])
    each = shown.select("question_id", "rank", F.explode(kinds).alias("k")).select("question_id", F.col("rank").alias("at"), "k.kind", F.explode("k.values").alias("value"))
    counted = each.groupBy("question_id", "kind", F.lower("value").alias("key")).agg(F.min_by("value", "at").alias("value"), F.count("*").alias("notes"))
    w = Window.partitionBy("question_id", "kind").orderBy(F.desc("notes"), "key")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).drop("key")


def prompt(question: Column, facts: Column, notes: Column, shown: Column, total: Column, dated: Column, one_document: bool = True) -> Column:
    """The request to a model: counted facts first, then notes, the question, and what may be said."""
    heading = "FACTS COUNTED OVER THE WHOLE DOCUMENT\n" if one_document else "FACTS COUNTED OVER EACH WHOLE DOCUMENT THAT IS SHOWN\n"
    coverage = F.when(shown < total, F.concat(F.lit("You see "), shown.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" notes."))).otherwise(F.lit("You see every note of the document." if one_document else "You see every note."))
    dates = F.when(dated, F.lit("\nGive dates as the notes write them.")).otherwise(F.lit(""))
    return F.concat(
        F.lit(heading), F.coalesce(F.nullif(facts, F.lit("")), F.lit("None.")), F.lit("\n\nNOTES\n"), coverage, F.lit("\n"), notes,
        F.lit("\n\nQUESTION\n"), question, F.lit("\n\nAnswer under WHAT THE DOCUMENT SAYS from the notes and facts alone, citing labels in square brackets; add WHAT IT SUGGESTS only if the notes support it. If they hold no answer, write: " + REFUSAL), dates,
    )


def notes_text(shown: DataFrame) -> DataFrame:
    """question_id, notes: labelled notes in rank order, for the prompt."""
    rows = shown.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "text"))).alias("n"))
    return rows.select("question_id", F.array_join(F.transform("n", lambda x: F.concat(F.lit("["), x["label"], F.lit("]\n"), x["text"])), "\n\n").alias("notes"))


def read_reply(reply: Column) -> Column:
    """struct(says, suggests): the two parts of a reply, whatever headings it forgot or ran into the text."""
    text = trimmed(F.regexp_replace(reply, rf"([^\n])\s*({_SECOND})", "$1\n\n$2"))
    empty = lambda c: F.nullif(trimmed(c), F.lit(""))
    has_second = text.rlike(f"(?i){_SECOND}")
    suggests = F.when(has_second, empty(F.regexp_extract(text, rf"(?is)^.*?{_SECOND}\s*:?\s*\n?(.*)$", 1)))
    has_first = text.rlike(f"(?i){_FIRST}")
    after = F.regexp_extract(text, rf"(?is)^.*?{_FIRST}\s*:?\s*\n?(.*)$", 1)
    says = F.when(has_first, empty(F.regexp_replace(after, rf"(?is)\n\s*{_SECOND}.*$", "")))
    before = F.when(has_second, empty(F.regexp_replace(text, rf"(?is){_SECOND}.*$", "")))
    whole = F.when(says.isNull() & before.isNull(), empty(text))
    return F.struct(F.coalesce(says, before, whole).alias("says"), F.when(says.isNotNull() | before.isNotNull(), suggests).alias("suggests"))


def nothing_further(suggests: Column) -> Column:
    text = trimmed(F.coalesce(suggests, F.lit("")))
    return (text == "") | text.rlike(r"(?i)^nothing further(?![A-Za-z0-9_])") | text.rlike(r"(?i)^read together,?\s+the notes suggest nothing further\.?$")


def is_refusal(reply: Column) -> Column:
    """Whether the first line that isn't a heading in capitals says that the document doesn't say."""
    says = F.coalesce(read_reply(reply)["says"], reply)
    lines = F.filter(F.transform(F.split(says, "\n"), trimmed), lambda x: (x != "") & ~x.rlike(r"^[A-Z0-9][A-Z0-9 ,'’&()/!?.-]*$"))
    return F.coalesce(F.get(lines, F.lit(0)).rlike(r"(?i)^the (?:document|diary)\s*(?:doesn'?t|does ?not)\s*say(?![A-Za-z0-9_])"), F.lit(False))


def refused_by(silent: Column, has_range_fact: Column, asks_range: Column, reply: Column) -> Column:
    """`search` if nothing was found and no counted fact answers, `model` if the reply refuses, else null."""
    overridden = asks_range & has_range_fact
    return F.when(silent & ~overridden, F.lit("search")).when(F.coalesce(is_refusal(reply), F.lit(False)), F.lit("model"))


def extractive_reply(notes: DataFrame) -> DataFrame:
    """question_id, reply: the default answerer. It quotes the first sentence of the best notes and invents nothing."""
    first = F.regexp_extract(F.col("text"), r"(?s)^\s*(.*?[.!?])(?:\s|$)", 1)
    quote = F.concat(F.when(first == "", F.substring("text", 1, 200)).otherwise(first), F.lit(" ["), F.col("label"), F.lit("]"))
    rows = notes.filter(F.col("rank") <= 3).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", quote.alias("q")))).alias("q"))
    return rows.select("question_id", F.concat(F.lit("WHAT THE DOCUMENT SAYS\n"), F.array_join(F.transform("q", lambda x: x["q"]), " ")).alias("reply"))
