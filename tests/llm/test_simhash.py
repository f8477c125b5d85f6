import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkloom.llm import simhash as S
from linkloom.llm.components import connected_components


def brute_fingerprint(text):
    words = ("" if text is None else text).encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    total = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        for b in range(64):
            total[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * total[b] > len(shingles))


def brute_components(prints, tau=3):
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = list(parent)
    for i, a in enumerate(items):
        for b in items[:i]:
            if (a ^ b).bit_count() <= tau:
                parent[find(a)] = find(b)
    return {f: find(f) for f in items}


def expected(rows):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    roots = brute_components({f for _, f in prints})
    first = {}
    for i, f in prints:
        if i is not None:
            first[roots[f]] = min(i, first.get(roots[f], i))
    return sorted((str(i), f"{f:016x}", first.get(roots[f])) for i, f in prints)


def got(df):
    return sorted((str(r.doc_id), f"{r.fp % 2**64:016x}", r.component_id) for r in df.collect())


def test_whole_table_against_brute_force(spark, small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    assert got(S.near_duplicates(small_docs)) == expected(rows)


def test_odd_rows(make_docs, odd_texts):
    docs = make_docs(odd_texts).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1.5))
    assert got(S.near_duplicates(docs)) == expected(odd_texts)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})


def test_empty(make_docs):
    assert got(S.near_duplicates(make_docs([]))) == []
    assert S.keep_one(make_docs([])).collect() == []


@pytest.mark.parametrize("block", [2048, 16])
def test_links_of_dense_and_random_fingerprints(spark, block):
    """A hot ball of fingerprints, chains across it and random ones; small blocks force splitting."""
    rng = np.random.default_rng(3)
    ball = [0xFFFF0000FFFF0000]
    for _ in range(300):
        ball.append(ball[rng.integers(len(ball))] ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    half = [0xABCD << 48 | int(x) for x in rng.integers(0, 2**48, 300)]
    free = [int(x) for x in rng.integers(0, 2**63, 300)]
    prints = sorted({x & (2**64 - 1) for x in ball + half + free})
    nodes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in prints], "fp bigint")
    links = S.hamming_links(nodes, block=block)
    found = {r.node % 2**64: r.root % 2**64 for r in connected_components(links).collect()}
    want = brute_components(prints)
    sets = lambda m: {frozenset(k for k in prints if m.get(k, k) == v) for v in {m.get(k, k) for k in prints}}
    assert sets(found) == sets(want)


def test_thresholds_always_sum(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 65536, (500, 4))
    values[:200, 0] = 7
    values[100:300, 2] = 9
    counts = [np.ones(65536, np.int64) for _ in range(4)]
    counts[0][7] = counts[2][9] = 100_000
    t = S.allocate(values, counts, [16] * 4)
    assert (t.sum(axis=1) == 0).all() and t.min() >= -1
    assert (t[:100, 0] == -1).all() and (t[200:300, 2] == -1).all() and (t[300:] == 0).all()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 400), (400, 500), (7, 7), (None, 3)], "a bigint, b bigint")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert roots == {**{i: 1 for i in range(1, 201)}, 400: 400, 500: 400}
