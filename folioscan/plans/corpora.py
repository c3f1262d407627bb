"""Dated documents made from the relational tables, the same in Spark and in SQL.

A diary for each customer: an entry for each order, in order of its key (so dates
run backwards at times), with an amount, places, people and now and then no date.
A ledger for each supplier and month: lines with numeric dates and amounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CITIES = ["Hamilton", "Toronto", "Grimsby", "London", "Paris", "Lisbon", "Oslo"]
NAMES = ["Marita Okafor", "Andrea Holt", "Martin Price", "Cecilia Brown", "Dr. Smith", "James Stone"]
SPELLINGS = ["Fairview", "Fairveiw", "Lakeside", "Lakesise", "Ridgeway"]


def _pick(key, values: list[str]):
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def _sql_pick(key: str, values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({key}) % {len(values)} + 1]"


def diary(read) -> DataFrame:
    """Entries: doc_id, idx, heading, date, date_raw, month, text."""
    # renamed before the window, so that what groups entries by doc_id finds them dealt by it
    o = read("orders").withColumnRenamed("o_custkey", "doc_id")
    key = F.col("o_orderkey")
    dated = key % 11 != 0
    raw = F.date_format("o_orderdate", "d MMMM yyyy")
    body = F.concat(
        F.lit("Order "), key.cast("string"), F.lit(" was placed for $"), F.format_string("%.2f", "o_totalprice"), F.lit(" in "), _pick(key, CITIES), F.lit(". We met "),
        _pick(F.col("doc_id") + F.floor(key / 3), NAMES), F.lit(" near "), _pick(key + 1, CITIES), F.lit(" and saw "), _pick(F.floor(key / 2), SPELLINGS), F.lit(" again. The boiler cost "), (key % 90 + 10).cast("string"), F.lit(" dollars."),
    )
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("o_orderkey")) - 1
    # numbered before the texts are made: what is dealt and sorted is some numbers a row
    numbered = o.select("doc_id", idx.alias("idx"), "o_orderkey", "o_orderdate", "o_totalprice")
    return numbered.select(
        "doc_id", "idx", F.when(key % 4 == 0, F.concat(F.lit("Visit "), (key % 5).cast("string"))).alias("heading"),
        F.when(dated, F.to_date("o_orderdate")).alias("date"), F.when(dated, raw).alias("date_raw"), F.when(dated | (key % 2 == 0), F.date_format("o_orderdate", "yyyy-MM")).alias("month"),
        F.when(dated, F.concat(raw, F.lit("\n"), body)).otherwise(body).alias("text"),
    )


DIARY_SQL = f"""
diary AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, CASE WHEN o_orderkey % 4 = 0 THEN 'Visit ' || (o_orderkey % 5) END AS heading,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS date, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%-d %B %Y') END AS date_raw,
  CASE WHEN o_orderkey % 11 <> 0 OR o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m') END AS month,
  CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%-d %B %Y') || chr(10) ELSE '' END ||
  'Order ' || o_orderkey || ' was placed for $' || printf('%.2f', o_totalprice) || ' in ' || {_sql_pick("o_orderkey", CITIES)} || '. We met ' || {_sql_pick("o_custkey + o_orderkey // 3", NAMES)} ||
  ' near ' || {_sql_pick("o_orderkey + 1", CITIES)} || ' and saw ' || {_sql_pick("o_orderkey // 2", SPELLINGS)} || ' again. The boiler cost ' || (o_orderkey % 90 + 10) || ' dollars.' AS text
FROM orders)"""


def diary_documents(read) -> DataFrame:
    """doc_id, text: a diary's entries joined by blank lines."""
    rows = diary(read).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("e"))
    return rows.select("doc_id", F.array_join(F.transform("e", lambda x: x["text"]), "\n\n").alias("text"))


DIARY_TEXT_SQL = f"{DIARY_SQL}, diary_text AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM diary GROUP BY doc_id)"


def ledger(read) -> DataFrame:
    """doc_id (order), idx, text: a line of a ledger for each line item, its date as numbers."""
    li = read("lineitem")
    text = F.concat(F.date_format("l_shipdate", "MM/dd/yyyy"), F.lit(" PAYMENT Part "), F.col("l_partkey").cast("string"), F.lit(" $"), F.format_string("%.2f", "l_extendedprice"))
    return li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("idx"), text.alias("text"))


LEDGER_SQL = "ledger AS (SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS idx, strftime(l_shipdate, '%m/%d/%Y') || ' PAYMENT Part ' || l_partkey || ' $' || printf('%.2f', l_extendedprice) AS text FROM lineitem)"


def jobs(read) -> DataFrame:
    """Entries with periods: doc_id, idx, label, month, end_month, open_ended, text."""
    o = read("orders")
    key = F.col("o_orderkey")
    start = F.date_format("o_orderdate", "yyyy-MM")
    end = F.date_format(F.add_months("o_orderdate", (key % 14).cast("int")), "yyyy-MM")
    open_ended, period = key % 9 == 0, key % 3 != 0
    written = F.date_format("o_orderdate", "MMMM yyyy")
    to = F.when(open_ended, F.lit(" to Present")).when(period, F.concat(F.lit(" to "), F.date_format(F.add_months("o_orderdate", (key % 14).cast("int")), "MMMM yyyy"))).otherwise(F.lit(""))
    return o.select(
        F.col("o_custkey").alias("doc_id"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("idx"), F.concat(F.lit("Job "), key.cast("string")).alias("label"),
        start.alias("month"), F.when(period & ~open_ended, end).alias("end_month"), open_ended.alias("open_ended"), F.concat(F.lit("Builder\n"), written, to, F.lit(", Hamilton\nBuilt things.")).alias("text"),
    )


JOBS_SQL = """
jobs AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, 'Job ' || o_orderkey AS label, strftime(o_orderdate, '%Y-%m') AS month,
  CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 9 <> 0 THEN strftime(o_orderdate + to_months((o_orderkey % 14)::INT), '%Y-%m') END AS end_month, o_orderkey % 9 = 0 AS open_ended FROM orders)"""
