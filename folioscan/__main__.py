"""Command line: index a file or a sample, and ask questions of what is stored.

    python -m folioscan index <file> [--year 2026] [--title T]
    python -m folioscan sample [diary|resume]
    python -m folioscan ask <doc_id> "<question>"
    python -m folioscan sample-ask [diary|resume] "<question>"
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .plans.engine import Engine
from .session import session
from .sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m folioscan")
    p.add_argument("--store", default=Config.read().store, help="folder of the store")
    commands = p.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="index a file")
    index.add_argument("file")
    index.add_argument("--year", type=int, help="the year of dates that name none")
    index.add_argument("--title")
    for name in ("sample", "sample-ask"):
        commands.add_parser(name).add_argument("sample", choices=sorted(readers.SAMPLES), nargs="?", default="diary")
    commands.choices["sample-ask"].add_argument("question")
    ask = commands.add_parser("ask", help="ask a stored document")
    ask.add_argument("doc_id")
    ask.add_argument("question")
    return p


def _sample(spark: SparkSession, name: str) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return readers.samples(spark).filter(F.col("doc_id") == name).withColumns({"year_hint": none("int"), "source_name": none("string")})


def _answer(engine: Engine, doc_id: str, question: str) -> dict:
    asked = engine.spark.createDataFrame([(1, question, doc_id)], "question_id long, question string, doc_id string")
    panels = engine.ask(asked)
    reply = panels["replies"].first()
    return {
        "says": reply.says, "suggests": reply.suggests, "refused_by": panels["refused"].first().refused_by,
        "notes": [r.label for r in panels["shown"].orderBy("rank").collect()], "facts": [r.sentence for r in panels["sentences"].orderBy("sentence").collect()],
        "warnings": [w for r in panels["warnings"].collect() for w in r.warnings],
    }


def run(arguments: list[str], spark: SparkSession) -> dict:
    """What the command line prints, as a dict."""
    args = parser().parse_args(arguments)
    engine = Engine(spark, args.store)
    if args.command == "index":
        year = F.lit(args.year).cast("int")
        docs = readers.read_files(spark, args.file).withColumns({"year_hint": year, "title": F.lit(args.title).cast("string")})
        return engine.add(docs) | {"doc_ids": [r.known_id for r in engine.known(docs).select("known_id").distinct().collect()]}  # a known document's id is the stored one
    if args.command == "ask":
        return _answer(engine, args.doc_id, args.question)
    added = engine.add(_sample(spark, args.sample))
    return added | {"doc_ids": [args.sample]} if args.command == "sample" else _answer(engine, args.sample, args.question)


if __name__ == "__main__":
    print(json.dumps(run(sys.argv[1:], session()), indent=1, ensure_ascii=False))
