import hashlib
import random
import re

from pyspark.sql import functions as F

from linkloom.llm import winnowing as W
from linkloom.llm.queries import QUERIES


def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    named |= found
        out.append((doc, len(w), len(hit), tuple(sorted(named))))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in df.collect()), key=str)


def test_whole_table(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    rows = QUERIES["op8_winnowing_decontamination"](spark, small).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    digest = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=str) == sorted(
        ((d, n, h, len(i), digest(i), h > 0) for d, n, h, i in want), key=str
    )


def test_planted_spans_short_items_and_odd_rows(spark, make_docs, odd_texts):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    pick = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, pick(rng.choice([1, 3, 9, 10, 11, 40]))) for i in range(60)] + [(7, pick(12)), (70, None), (71, ""), (72, "Ünïcödé"), (73, "one two")]
    docs = [(100 + i, pick(60) + " " + (rng.choice(items)[1] or "").upper() if i % 3 else pick(80)) for i in range(40) if i] + odd_texts
    docs = [(i, t) for i, t in docs if t is None or len(t) < 10**6]
    frame = make_docs(docs).withColumn("n_hit", F.lit("clash")).withColumn("item_id", F.lit(1))
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(3))
    assert got(W.contamination(frame, table)) == brute(docs, items)
    kept = W.drop_contaminated(frame, table)
    assert kept.columns == frame.columns
    bad = {d for d, _, h, _ in brute(docs, items) if h}
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert got(W.contamination(make_docs(["a b c"]), none)) == [(0, 3, 0, ())]
    assert W.contamination(make_docs([]), none).collect() == []
