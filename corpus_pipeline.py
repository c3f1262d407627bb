"""A corpus pipeline: language ID, near-dedup, personal data, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import langid, mixing, packing, pii, simhash
from folioscan.llm.common import table
from folioscan.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay."""
    ship(spark)
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id.

    Near duplicates share 0.8 of their five-word shingles or more, as 512 bits of SimHash tell.
    """
    ship(spark)
    return simhash.keep_one(docs, words=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("personal_data", personal_data), ("source_mix", source_mix), ("packing", pack)]

#: Tokenisation, models and an iterated dual aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
