"""Month series, mention grids, periods and shares: the numbers behind charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_of_ordinal, month_ordinal

MOST_MONTHS, SPINE_LIMIT = 1200, 400
UNDATED = "undated"
GRID_ROWS = {"person": 3, "place": 3, "amount": 2}


def continuous_months(per_month: DataFrame, bounds: DataFrame) -> DataFrame:
    """doc_id, month, entries from the first to the last dated month, empty months included.

    per_month: doc_id, month, entries; bounds: doc_id, first_date, last_date (null: the
    series' own). Where the bounds run backwards the series is returned as it is.
    """
    own = per_month.groupBy("doc_id").agg(F.min("month").alias("low"), F.max("month").alias("high")).join(bounds.select("doc_id", "first_date", "last_date"), "doc_id", "left")
    month = lambda d: F.date_format(d, "yyyy-MM")
    a = month_ordinal(F.coalesce(month("first_date"), F.col("low")))
    b = month_ordinal(F.coalesce(month("last_date"), F.col("high")))
    axis = own.withColumn("a", a).withColumn("b", F.least(b, a + MOST_MONTHS - 1))
    forward = axis.filter("b >= a").select("doc_id", F.explode(F.sequence("a", "b")).alias("n")).select("doc_id", month_of_ordinal(F.col("n")).alias("month"))
    filled = forward.join(per_month, ["doc_id", "month"], "left").select("doc_id", "month", F.coalesce("entries", F.lit(0)).alias("entries"))
    back = per_month.join(axis.filter("b < a").select("doc_id"), "doc_id", "left_semi").select("doc_id", "month", "entries")
    return filled.unionByName(back)


def mention_grid(held: DataFrame, rows: DataFrame, axis: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, kind, value, month, notes: in how many pieces of each month a top mention stands.

    held: doc_id, idx (entry), kind, value of pieces; rows: the mentions to show; axis:
    doc_id, month. Pieces of no month on the axis count as `undated`, a column that is
    only there when something is in it.
    """
    dated = entries.select("doc_id", "idx", "month").join(axis.withColumn("on_axis", F.lit(True)), ["doc_id", "month"], "left")
    dated = dated.select("doc_id", "idx", F.when(F.col("on_axis"), F.col("month")).otherwise(F.lit(UNDATED)).alias("month"))
    wanted = rows.select("doc_id", "kind", F.lower("value").alias("key"), "value")
    counted = held.select("doc_id", "idx", "kind", F.lower("value").alias("key")).join(wanted, ["doc_id", "kind", "key"]).join(dated, ["doc_id", "idx"]).groupBy("doc_id", "kind", "value", "month").agg(F.count("*").alias("notes"))
    undated = counted.filter(F.col("month") == UNDATED).select("doc_id", "month").distinct()
    cells = wanted.select("doc_id", "kind", "value").join(axis.select("doc_id", "month").unionByName(undated), "doc_id")
    return cells.join(counted, ["doc_id", "kind", "value", "month"], "left").na.fill(0, ["notes"])


def spine(entries: DataFrame, cited: DataFrame, limit: int = SPINE_LIMIT) -> DataFrame:
    """doc_id, mode, pos, label, cited, entries: a cell an entry, or beyond `limit` entries a run of equal months.

    entries: doc_id, idx, label, month; cited: doc_id, idx.
    """
    w = Window.partitionBy("doc_id").orderBy("idx")
    marks = cited.select("doc_id", "idx").distinct().withColumn("cited", F.lit(True))
    rows = entries.join(marks, ["doc_id", "idx"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    rows = rows.withColumn("total", F.count("*").over(Window.partitionBy("doc_id"))).withColumn("key", F.coalesce("month", F.lit(UNDATED)))
    rows = rows.withColumn("opens", F.coalesce(F.col("key") != F.lag("key").over(w), F.lit(True)).cast("int"))
    by_month = F.col("total") > limit
    rows = rows.withColumn("pos", F.when(by_month, F.sum("opens").over(w) - 1).otherwise(F.row_number().over(w) - 1))
    cells = rows.groupBy("doc_id", "pos", "total").agg(F.min_by(F.when(by_month, F.col("key")).otherwise(F.col("label")), "idx").alias("label"), F.bool_or("cited").alias("cited"), F.count("*").alias("entries"))
    return cells.select("doc_id", F.when(by_month, F.lit("month")).otherwise(F.lit("entry")).alias("mode"), "pos", "label", "cited", "entries")


def spans(entries: DataFrame) -> DataFrame:
    """doc_id, idx, label, from_month, to_month, open_ended, point of entries with a month.

    An end before its start is its start; a period that still runs goes to the end of
    what the document states.
    """
    start = F.col("month")
    to = F.when(F.col("end_month") >= start, F.col("end_month")).otherwise(start)
    running = F.col("end_month").isNull() & F.col("open_ended")
    rows = entries.filter("month IS NOT NULL").select("doc_id", "idx", "label", start.alias("from_month"), to.alias("to_month"), running.alias("open_ended"))
    end = F.max("to_month").over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("to_month", F.when(F.col("open_ended"), F.greatest("to_month", end)).otherwise(F.col("to_month")))
    return rows.withColumn("point", F.col("from_month") == F.col("to_month"))


def lanes(span_rows: DataFrame) -> DataFrame:
    """spans with their lane: the first row whose last period has ended, in document order; points share one row below.

    A sequential rule within a document: a fold over its sorted periods.
    """
    period = F.struct("idx", month_ordinal(F.col("from_month")).alias("a"), month_ordinal(F.col("to_month")).alias("b"))
    per = span_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(~F.col("point"), period))).alias("p"))

    def place(state: Column, x: Column) -> Column:
        free = F.coalesce(F.array_min(F.filter(F.transform(state["ends"], lambda e, i: F.when(e < x["a"], i)), lambda i: i.isNotNull())), F.size(state["ends"]))
        ends = F.when(free == F.size(state["ends"]), F.concat(state["ends"], F.array(x["b"]))).otherwise(F.transform(state["ends"], lambda e, i: F.when(i == free, x["b"]).otherwise(e)))
        return F.struct(ends.alias("ends"), F.concat(state["out"], F.array(F.struct(x["idx"].alias("idx"), free.alias("lane")))).alias("out"))

    idx_type = span_rows.schema["idx"].dataType.simpleString()
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.array().cast(f"array<struct<idx:{idx_type},lane:int>>").alias("out"))
    placed = per.select("doc_id", F.size("p").alias("periods"), F.aggregate("p", start, place, lambda s: s["out"]).alias("out"))
    bars = placed.select("doc_id", F.explode("out").alias("o")).select("doc_id", "o.idx", "o.lane")
    rows = span_rows.join(placed.select("doc_id", "periods"), "doc_id").join(bars, ["doc_id", "idx"], "left")
    return rows.withColumn("lane", F.coalesce("lane", "periods")).drop("periods")


def axis_months(span_rows: DataFrame) -> DataFrame:
    """doc_id, from_month, to_month, months of the whole axis."""
    ends = span_rows.groupBy("doc_id").agg(F.min("from_month").alias("from_month"), F.max("to_month").alias("to_month"))
    return ends.withColumn("months", F.greatest(F.lit(1), month_ordinal(F.col("to_month")) - month_ordinal(F.col("from_month")) + 1))


def span_phrase(months: Column) -> Column:
    """`7 months`, `2 years`, `2 years 3 months`; under two years in months."""
    unit = lambda n, one: F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))
    years, rest = F.floor(months / 12).cast("int"), months % 12
    return F.when(months < 24, unit(months, "month")).when(rest == 0, unit(years, "year")).otherwise(F.concat(unit(years, "year"), F.lit(" "), unit(rest, "month")))


def note_map(notes: DataFrame) -> DataFrame:
    """doc_id, note_id, chars, share of the document, longest share, dominated (one of several notes has over half)."""
    w = Window.partitionBy("doc_id")
    rows = notes.withColumn("chars", F.length("text").cast("long"))
    total = F.sum("chars").over(w)
    share = F.when(total > 0, F.col("chars") / total).otherwise(F.lit(0.0))
    rows = rows.select("doc_id", "note_id", "chars", share.alias("share"), F.count("*").over(w).alias("notes"))
    return rows.withColumn("longest", F.max("share").over(w)).withColumn("dominated", (F.col("notes") > 1) & (F.col("longest") > 0.5))


def funnel(stages: DataFrame) -> DataFrame:
    """question_id, step, label, notes: what is left after each stage; a stage that didn't run (null) has no row."""
    silent = F.coalesce("silent", F.lit(False))
    step = lambda k, label, n: F.struct(F.lit(k).alias("step"), F.lit(label).alias("label"), n.cast("long").alias("notes"))
    steps = F.array(
        step(0, "in the document", F.col("notes")), step(1, "matched the question", F.when(silent, F.lit(0))), step(2, "ranked by both searches", F.when(~silent, F.col("ranked"))),
        step(3, "weighed by the reranker", F.when(~silent, F.col("reranked"))), step(4, "shown to the model", F.when(~silent, F.col("shown"))),
    )
    return stages.select("question_id", F.explode(F.filter(steps, lambda s: s["notes"].isNotNull())).alias("s")).select("question_id", "s.*")
