import os

import pytest
import samples

import corpus_pipeline
from cohortlens.llm import toxicity
from cohortlens.llm.jaccard import join
from cohortlens.llm.queries import PIECE_MODEL

pytestmark = pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no model file")
FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], FOLDER).cache()
        assert out.columns == docs.columns
        kept.append(out)
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))

    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), toxicity.training_fold())
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert ids[1] == ids[0] - toxic
    assert ids[2] == {r["doc_id"] for r in join(kept[1]).where("doc_id = component_id").collect()}
    assert ids[4] == ids[3]
    lengths = kept[4].selectExpr("n_chars = length(text) AS same").distinct().collect()
    assert [r["same"] for r in lengths] == [True]

    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in out} == ids[4]
    assert all(r["round_trip"] for r in out)


def test_stages_take_any_rows(spark):
    docs = samples.documents(spark)
    for rows in (docs, samples.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, FOLDER)
            assert rows.columns == docs.columns
        corpus_pipeline.encode(spark, rows, FOLDER).collect()
