import corpus_pipeline as C
from pyspark.sql import functions as F

from linkloom.llm.common import staged


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in C.STAGES:
        before = docs
        docs = staged(stage(spark, docs, small), name)
        sizes.append(docs.count())
        if name != "piece_encoding":
            assert docs.columns == before.columns
        kept = docs.select("doc_id").join(before.select("doc_id"), "doc_id", "left_anti")
        assert kept.count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[5] > 0.5 * sizes[0]
    assert docs.filter(~F.col("lossless")).count() == 0
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii_redaction", "piece_encoding"]
    good = labels.filter("quality = 1").count()
    stage1 = C.quality_classifier(spark, spark.read.parquet(f"{small}/documents.parquet"), small)
    assert stage1.join(labels.filter("quality = 1"), "doc_id").count() > 0.95 * good


CLASHES = ("_gone_id", "_gone_key", "_hashed", "_found", "_row_id", "_cuts", "_cut_id", "_again_id", "_again_key", "key", "fp", "row_id", "n", "root", "hits")


def test_stages_tell_rows_of_one_id_apart(spark, make_docs):
    """Repeated and missing ids, ties, NULL and empty texts, and columns with the names used inside."""
    words = "the quick brown fox jumps over the lazy dog while seven small wizards mix nine jugs of fresh blue ink".split()
    text = lambda n: " ".join(f"{w}{n}" for w in words * 3)
    bench = " ".join(f"item{i}" for i in range(12))
    rows = [(1, text(1)), (1, text(2)), (2, text(1)), (None, text(3)), (None, text(3)), (None, text(4)), (5, text(5) + " " + bench), (5, text(6)), (None, bench + " tail"), (7, text(7)), (7, text(7)), (8, None), (9, "")]
    docs = make_docs(rows)
    for i, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.lit(i))
    kept = C.simhash_near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    texts = lambda df: sorted((r.doc_id or -1, r.text or "") for r in df.collect())
    expected = [(1, text(1)), (1, text(2)), (None, text(3)), (None, text(4)), (5, text(5) + " " + bench), (5, text(6)), (None, bench + " tail"), (7, text(7)), (8, "")]
    assert texts(kept) == sorted((i or -1, t) for i, t in expected)
    items = spark.createDataFrame([("b", bench)], "item_id string, text string")
    clean = C.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and texts(clean) == sorted((i or -1, t or "") for i, t in rows if bench not in (t or ""))
    mails = docs.withColumn("text", F.concat_ws(" ", "text", F.lit("a.b@example.com")))
    cut = C.pii_redaction(spark, mails, "")
    assert cut.columns == docs.columns and {tuple(r[n] for n in CLASHES) for r in cut.collect()} == {tuple(range(len(CLASHES)))}
    assert all("[EMAIL]" in r.text for r in cut.collect())
    empty = docs.limit(0)
    assert C.simhash_near_dedup(spark, empty, "").count() == C.drop_contaminated(empty, items).count() == C.pii_redaction(spark, empty, "").count() == 0
