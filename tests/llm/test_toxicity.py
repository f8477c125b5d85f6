import numpy as np
from pyspark.sql import functions as F

from linkloom.llm import toxicity as T
from linkloom.llm.queries import QUERIES


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op6_toxicity_chain"](spark, folder).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert np.mean([r.toxic for r in held if labels[r.doc_id]]) > 0.7
    assert np.mean([r.toxic for r in held if not labels[r.doc_id]]) < 0.03


def test_odd_rows(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts + [(100 + i, f"you are an idiot and trash number{i}" if i % 2 else f"a fine sentence about weather number{i}") for i in range(80)])
    labels = spark.createDataFrame([(100 + i, None, i % 2) for i in range(80)] + [(None, 1, 1), (101, 1, None)], "doc_id bigint, quality int, toxic int")
    rows = T.categorised(docs.withColumn("label", F.lit("x")).withColumn("toxic", F.lit("y")), labels).collect()
    assert len(rows) == docs.count()
    assert all(r.toxic == bool(r.doc_id % 2) for r in rows if r.doc_id is not None and r.doc_id >= 100)
    assert not any(r.toxic for r in rows if r.doc_id in (1, 2, 3))
    assert not any(r.toxic for r in T.categorised(docs, labels.limit(0)).collect())
    assert T.categorised(make_docs([]), labels).collect() == []


def test_later_models_see_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    a = (x[:, 0] + rng.normal(size=600) > 0).astype(float)
    b = np.where(rng.random(600) < 0.9, a, 1 - a)
    models = T.fit_chain(x, np.stack([a, b], axis=1), rng.integers(0, 5, 600))
    assert [len(m) for m in models] == [6, 7] and models[1][5] > 0
    p = T.predict_chain(models, x)
    assert ((p[:, 0] > 0.5) == a).mean() > 0.7 and ((p[:, 1] > 0.5) == b).mean() > 0.65
