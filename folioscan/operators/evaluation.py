"""Measuring answers: golden cases, stability over runs, completeness, and the floor under which a search is silent.

Cases and replies are tables, so that many runs of many cases are judged by one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judge(cases: DataFrame, replies: DataFrame) -> DataFrame:
    """case_id, run, passed, missing, forbidden, wrongly_refused, wrongly_answered of replies (case_id, run, reply, refused).

    cases: case_id, must and must_not (arrays of patterns), refuse (whether a refusal is the right reply).
    A null reply is empty. Replies without a case, and cases without a reply, aren't judged.
    """
    rows = replies.join(cases, "case_id").withColumn("reply", F.coalesce("reply", F.lit("")))
    refuse, refused = F.coalesce("refuse", F.lit(False)), F.coalesce("refused", F.lit(False))
    patterns = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    answered = ~refuse & ~refused
    missing = F.when(answered, F.filter(patterns("must"), lambda p: ~F.regexp_like(F.col("reply"), p))).otherwise(F.array().cast("array<string>"))
    forbidden = F.when(answered, F.filter(patterns("must_not"), lambda p: F.regexp_like(F.col("reply"), p))).otherwise(F.array().cast("array<string>"))
    judged = rows.select("case_id", "run", missing.alias("missing"), forbidden.alias("forbidden"), (~refuse & refused).alias("wrongly_refused"), (refuse & ~refused).alias("wrongly_answered"))
    return judged.withColumn("passed", (F.size("missing") == 0) & (F.size("forbidden") == 0) & ~F.col("wrongly_refused") & ~F.col("wrongly_answered"))


def stability(judged: DataFrame) -> DataFrame:
    """case_id, runs, passes, stable: a case is stable if all of its runs pass or none does."""
    rows = judged.groupBy("case_id").agg(F.count("*").alias("runs"), F.count_if("passed").alias("passes"))
    return rows.withColumn("stable", F.col("passes").isin(0) | (F.col("passes") == F.col("runs")))


def completeness(replies: DataFrame, items: DataFrame) -> DataFrame:
    """case_id, run, named, needed, left_out: how many of a case's items (case_id, item) each reply names, in any case of letters.

    A refused or null reply names none; repeated items count once.
    """
    needed = items.filter(F.col("item").isNotNull()).groupBy("case_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    text = F.lower(F.coalesce("reply", F.lit("")))
    rows = replies.join(needed, "case_id").withColumn("left_out", F.filter("items", lambda i: ~F.contains(text, F.lower(i))))
    return rows.select("case_id", "run", (F.size("items") - F.size("left_out")).cast("long").alias("named"), F.size("items").cast("long").alias("needed"), "left_out")


def best_cosines(ranking: DataFrame) -> DataFrame:
    """question_id, best: the greatest cosine of each question of a vector ranking."""
    return ranking.groupBy("question_id").agg(F.max("score").alias("best"))


def refusal_floor(best: DataFrame) -> DataFrame:
    """noise_top, signal_low, floor of best cosines (noise, best): the midway of the two where they part, else null."""
    rows = best.agg(F.max(F.when(F.col("noise"), F.col("best"))).alias("noise_top"), F.min(F.when(~F.col("noise"), F.col("best"))).alias("signal_low"))
    apart = F.col("signal_low") > F.col("noise_top")
    return rows.withColumn("floor", F.when(apart, (F.col("noise_top") + F.col("signal_low")) / 2))
