import os

import pytest

import corpus_pipeline
from brandloom.llm import exact_dedup, near_dedup, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before, after = docs.select("doc_id").collect(), out.select("doc_id").collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            clean = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 0").collect()}
            assert {r.doc_id for r in after} == clean
        elif name == "exact dedup":
            assert {r.doc_id for r in after} == {r.doc_id for r in exact_dedup.exact_dedup(docs).filter("kept").collect()}
        elif name == "near dedup":
            assert {r.doc_id for r in after} == {r.doc_id for r in near_dedup.near_components(docs).filter("kept").collect()}
        elif name == "source mix":
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) > len(before)
        else:
            assert len(after) >= len(before) and out.filter("not round_trip").count() == 0
        docs = out


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).filter("round_trip").count() > 0
