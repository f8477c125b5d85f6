import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import negatives as N

DDL = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100):
    ok = [(n, i, [math.floor(256 * float(np.float32(x))) for x in v], c) for n, (i, v, c) in enumerate(rows) if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, i, v, c in ok:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, b, d) for b, j, w, d in ok if b != a)
        for s, j, _, _ in [x for x in scored if x[3] == c][:5]:
            near = [x for x in scored if x[3] != c and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, r, k, -s, -t) for r, (t, k, _, _) in enumerate(near, 1)]
    return sorted(out)


def make(seed, n=260, width=20):
    rng = random.Random(seed)
    base = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(4)]
    rows = [(i, [x + rng.uniform(-0.3, 0.3) for x in rng.choice(base)], rng.randrange(3)) for i in range(n)]
    rows += [(n + i, [0.5] * width, i % 3) for i in range(40)]  # ties
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(N, "CHUNK", 32)
    monkeypatch.setattr(N, "BLOCK", 3)
    rows = make(seed)
    got = N.hard_negatives(spark.createDataFrame(rows, DDL).repartition(3), every=20).collect()
    assert sorted(map(tuple, got)) == brute(rows, 20) and len(got) > 50


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 0.5], 1), (1, [1.0, 1.0], 1), (2, [0.9, 1.0], 2), (3, [0.9, 1.0, 0.0], 2), (3, [0.9, 1.0], 2), (4, [1.0], 2), (5, [], 2), (6, None, 2), (None, [1.0, 1.0], 2), (7, [1.0, None], 2), (8, [nan, 1.0], 2), (9, [inf, 1.0], 2), (10, [1.0, 1.0], None), (-100, [-1.0, -1.0], 2)]
    got = sorted(map(tuple, N.hard_negatives(spark.createDataFrame(rows, DDL)).collect()))
    assert got == brute(rows) and any(r[0] == 0 for r in got)
    frame = spark.createDataFrame(rows, DDL)
    for name in ("id", "row", "part", "rank", "block", "score", "vector"):
        frame = frame.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, N.hard_negatives(frame).collect())) == got
    assert N.hard_negatives(spark.createDataFrame([], DDL)).count() == 0
    assert N.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], DDL)).count() == 0
    with pytest.raises(ValueError, match="too large"):
        N.hard_negatives(spark.createDataFrame([(1, [1e30], 1)], DDL))


def test_anchors_are_not_broadcast(spark, monkeypatch):
    """Blocks of anchors are read where they meet the chunks, not copied for each part and sent through the driver."""
    plans, original = {}, N.staged
    monkeypatch.setattr(N, "staged", lambda df, label: plans.update({label: df._jdf.queryExecution().executedPlan().toString()}) or original(df, label))
    monkeypatch.setattr(N, "CHUNK", 32)
    N.hard_negatives(spark.createDataFrame(make(3), DDL), every=20)
    assert set(plans) == {"vectors", "chunks", "blocks", "positives", "negatives"}
    assert "CartesianProduct" in plans["positives"] and "CartesianProduct" in plans["negatives"]
    assert not [label for label, plan in plans.items() if "Broadcast" in plan or "Generate" in plan]


@pytest.mark.parametrize("width", [1, 7, 8, 64, 65])
def test_tables_give_inner_products(width):
    rng = np.random.default_rng(width)
    anchors, rows = rng.integers(-300, 300, (13, width)), rng.integers(-512, 512, (50, width))
    assert (N.scores(N.subset_sums(anchors, np.int32), N.bit_planes(rows, 10)) == rows @ anchors.T).all()
