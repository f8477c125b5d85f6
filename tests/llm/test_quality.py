import duckdb
import numpy as np
from pyspark.sql import functions as F

from linkloom.catalog.check import TABLES, canonical
from linkloom.llm import quality as Q
from linkloom.llm import quality_rules as R
from linkloom.llm.queries import ORACLES, QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op2_quality_discriminant"](spark, folder).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifier_on_odd_rows(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts + [(100 + i, "plain words in a line " * (1 + i % 7)) for i in range(40)] + [(200 + i, "!!! $$$ ### " * (2 + i % 5)) for i in range(40)])
    labels = spark.createDataFrame([(100 + i, 1, None) for i in range(40)] + [(200 + i, 0, None) for i in range(40)] + [(200, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    clash = docs.withColumn("x", F.lit(1)).withColumn("score", F.lit("s"))
    rows = Q.scored(clash, labels).collect()
    assert len(rows) == docs.count()
    low, high = ([r.score for r in rows if r.doc_id is not None and a <= r.doc_id < a + 40] for a in (200, 100))
    assert max(low) < 0.3 <= min(high)
    assert Q.keep_good(clash, labels).columns == clash.columns
    none = labels.limit(0)
    assert {r.score for r in Q.scored(docs, none).collect()} != set() and Q.scored(make_docs([]), labels).collect() == []


def test_factors_give_the_densities():
    rng = np.random.default_rng(0)
    mean, cov = rng.normal(size=(2, 3)), [np.diag([1.0, 2.0, 3.0]), np.array([[2.0, 0.5, 0], [0.5, 1.0, 0], [0, 0, 1.0]])]
    model = Q.Discriminant(mean, np.stack([np.linalg.cholesky(c) for c in cov]), 0.3)
    x = rng.normal(size=(50, 3))
    log = [-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) - 0.5 * np.log(np.linalg.det(c)) for m, c in zip(mean, cov, strict=True)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(log[0] - log[1] + 0.3))))


def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def test_rules_against_sql(spark, small):
    name = "op1_adaptive_quality_rules"
    assert canonical(QUERIES[name](spark, small).toPandas()) == canonical(duck(small).sql(ORACLES[name]).df())


def brute_counts(text):
    w = [x for x in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if x]
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_rules_on_odd_rows(make_docs, odd_texts):
    line = "to be or not to be that is the question here"
    texts = odd_texts + [(20, "\n".join([line] * 5)), (21, line + " " + line), (22, "a b c d e f g h " * 3), (23, "* | <x> " * 30), (24, None)]
    docs = make_docs(texts).withColumn("words", F.lit(0)).withColumn("f_lang", F.lit("x")).withColumn("lang", F.when(F.col("doc_id") > 20, F.lit(None)).otherwise("en"))
    rows = R.judged(docs).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted((str(i), *brute_counts(t)) for i, t in texts)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept in (True, False) and not (r.base_failed and r.kept) for r in rows)
    assert R.judged(make_docs([])).collect() == []


def test_thresholds_follow_the_source(spark, make_docs):
    """Symbols that are common in one source are kept there and taken out of another."""
    noisy = [(i, "word $ " * 30 + f"end{i}") for i in range(150)]
    plain = [(1000 + i, "some plain words of text " * 6 + f"end{i}") for i in range(150)] + [(2000, "word $ " * 30 + "last")]
    unlike = lambda rows: [(i, " ".join(f"{w}{k}" if w != "$" else w for k, w in enumerate(t.split()))) for i, t in rows]
    docs = make_docs(unlike(noisy), source="a").unionByName(make_docs(unlike(plain), source="b"))
    kept = {r.doc_id: r.kept for r in R.judged(docs).collect()}
    assert all(kept[i] for i, _ in noisy) and all(kept[1000 + i] for i in range(150)) and not kept[2000]
