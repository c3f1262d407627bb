from __future__ import annotations

import corpus_pipeline
from folioscan.llm import mixing, simhash

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes[name] = docs.count()
        if name != "packing":
            assert docs.columns == columns
        if name == "near_dedup":
            ids = {r.doc_id for r in docs.collect()}
            groups = simhash.grouped(before, words=5, similarity=0.8).groupBy("root").agg({"doc_id": "min"}).collect()
            assert ids == {r[1] for r in groups}
        if name == "personal_data":
            assert sizes[name] == sizes["near_dedup"] and docs.filter("text LIKE '%@mail%.example.com%'").count() == 0
        if name == "source_mix":
            taken = mixing.taken_words(before).selectExpr("sum(copies)").first()[0]
            assert sizes[name] == taken
        if name == "packing":
            assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").distinct().collect()}
    assert 180 <= sizes["language_id"] <= 200 and sizes["near_dedup"] < sizes["language_id"]


def test_stages_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    for which, docs in (("odd", odd), ("empty", empty)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / which / str(k))
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
