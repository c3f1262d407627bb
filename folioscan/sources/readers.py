"""Sources of documents: JSON, whole text files, pages, PDFs through an extractor, samples."""

from __future__ import annotations

import multiprocessing
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

LEAST_CHARS, MOST_CHARS = 200, 1_000_000
DOCUMENT = "doc_id string, text string, title string, year_hint int, source_name string"


def with_ids(df: DataFrame) -> DataFrame:
    """(doc_id, text, title, year_hint, source_name); the id is a hash of the content, the same on every read."""
    have = set(df.columns)
    column = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    return df.select(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 12).alias("doc_id"), "text", column("title", "string").alias("title"), column("year", "int").alias("year_hint"), column("source_name", "string").alias("source_name"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of text, title, year, source_name; lines that are no object are dropped with their path in `corrupt`."""
    schema = "text string, title string, year int, source_name string, corrupt string"
    return with_ids(spark.read.schema(schema).option("columnNameOfCorruptRecord", "corrupt").json(path).filter("corrupt IS NULL"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Lines of newline-delimited JSON: kind (result, error, event, web page or unreadable), type, error, line. Blank lines go."""
    rows = spark.read.text(path).select(tx.trimmed(F.col("value")).alias("line")).filter("line <> ''")
    field = lambda name: F.get_json_object("line", f"$.{name}")
    json = F.try_parse_json("line").isNotNull()
    kind = F.when(~json & F.col("line").rlike(r"(?i)^<(?:!doctype|html)"), "web page").when(~json, "unreadable").when(field("type").isin("result", "error"), field("type")).otherwise("event")
    error = F.when(kind == "error", F.coalesce(field("error"), F.lit("no reason was given"))).when(kind.isin("web page", "unreadable"), F.substring("line", 1, 100))
    return rows.select(kind.alias("kind"), F.when(json, field("type")).alias("type"), error.alias("error"), "line")


def result_of(events: DataFrame) -> str:
    """The result line of read_events(); an error if a line is one or can't be read, or if there is no result."""
    if bad := events.filter("kind NOT IN ('result', 'event')").select("kind", "error").first():
        raise ValueError(f"{bad.kind}: {bad.error}")
    if (found := events.filter("kind = 'result'").select("line").first()) is None:
        raise ValueError("no result came")
    return found.line


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Text, Markdown, CSV and HTML files, each one document as it is written."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_name"))
    return with_ids(rows)


#: Seconds that the text of one file may take.
EXTRACT_SECONDS = 30


class Unreadable(RuntimeError):
    """A file whose text can't be taken out, with the reason."""


def guarded(extract, data: bytes, seconds: float = EXTRACT_SECONDS) -> str:
    """extract(data) in a process of its own, which ends with the time limit; Unreadable says why there is no text.

    So a file that hangs, or brings its reader down, costs its own time and no other file's.
    """
    fork = multiprocessing.get_context("fork")
    ours, theirs = fork.Pipe(duplex=False)

    def work() -> None:
        try:
            theirs.send((True, extract(data)))
        except BaseException as e:  # noqa: BLE001  the reason goes to the reader's row
            theirs.send((False, f"{type(e).__name__}: {e}"[:200]))

    child = fork.Process(target=work, daemon=True)
    child.start()
    theirs.close()
    try:
        if not ours.poll(seconds):
            raise Unreadable(f"no text within {seconds:g} seconds")
        try:
            good, value = ours.recv()
        except EOFError:
            raise Unreadable("its reader broke down") from None
        if not good:
            raise Unreadable(value)
        return value
    finally:
        child.kill()
        child.join()
        ours.close()


def by_command(*command: str):
    """An extractor that gives the file to a command's standard input and takes its output: by_command("pdftotext", "-layout", "-", "-")."""

    def extract(data: bytes) -> str:
        done = subprocess.run(command, input=data, capture_output=True)
        if done.returncode:
            raise Unreadable(done.stderr.decode(errors="replace").strip()[:200] or f"it ended with {done.returncode}")
        return done.stdout.decode(errors="replace")

    return extract


def read_pdfs(spark: SparkSession, path: str, extract, seconds: float = EXTRACT_SECONDS) -> DataFrame:
    """PDF files through extract(bytes) -> text, run on the executors under a time limit; others and empty texts are refused with a reason.

    Returns (source_name, text, reason): reason is null for documents that can be used.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)

    def run(batches):
        for pdf in batches:
            out = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                if not bytes(data[:4]) == b"%PDF":
                    out.append((name, None, "not a PDF file"))
                    continue
                try:
                    text = guarded(extract, bytes(data), seconds)
                except Unreadable as e:  # one file that can't be read is refused, and the batch goes on
                    out.append((name, None, f"the PDF file can't be read: {e}"[:250]))
                    continue
                out.append((name, text if text.strip() else None, None if text.strip() else "no text in the PDF file"))
            yield pd.DataFrame(out, columns=["source_name", "text", "reason"])

    return files.select("path", "content").mapInPandas(run, "source_name string, text string, reason string")


def admit(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with plain text of a fit length, refused: doc_id, characters, reason). A batch never fails for one document."""
    prepared = docs.withColumn("text", tx.prepare(F.col("text")))
    n = F.length("text")
    reason = F.when(n < LEAST_CHARS, F.lit(f"under {LEAST_CHARS} characters")).when(n > MOST_CHARS, F.lit(f"over {MOST_CHARS} characters"))
    judged = prepared.withColumn("characters", n).withColumn("reason", reason)
    return judged.filter("reason IS NULL").drop("reason", "characters"), judged.filter("reason IS NOT NULL").select("doc_id", "characters", "reason")


_DIARY = """3 March 2025

The pipes froze again. I rang Dr. Moore in Grimsby and he said to wait.

9 March 2025

A plumber came from Leeds and asked $240 for the morning. We talked about Anna for an hour, and Anna rang in the evening.

2 May 2025

Warm at last. We drove to Lisbon in the end and paid 90 euros for the night. Then Anna wrote."""
_RESUME = """SUMMARY

Builder of small machines.

EXPERIENCE

Fitter, North Works
May 2019 to Present, Leeds
Keeps the presses running.

Apprentice, Quay Yard
January 2016 to April 2019, Glasgow
Learned to weld.

EDUCATION

College of Clyde
Mechanics, 2015"""
SAMPLES = {"diary": _DIARY, "resume": _RESUME}


def samples(spark: SparkSession) -> DataFrame:
    """The built-in documents: doc_id, text, title."""
    rows = [(k, t, k.title()) for k, t in SAMPLES.items()]
    return spark.createDataFrame(rows, "doc_id string, text string, title string")
