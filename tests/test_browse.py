"""Paging and walks on a tree of 12 001 nodes, 100 children each; small guards and queue rules."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import html as H
from linkloom.operators import browse as B
from linkloom.operators import frontier as Q
from linkloom.operators import graph as G
from linkloom.operators import stats as S


@pytest.fixture(scope="module")
def tree(spark):
    n = F.col("id")
    return spark.range(12_001).select(
        F.lpad(n.cast("string"), 6, "0").alias("id"),
        F.lit("s").alias("site_id"),
        F.when(n > 0, F.lpad(F.floor((n - 1) / 100).cast("string"), 6, "0")).alias("effective_parent_id"),
        F.when(n == 0, 0).when(n <= 100, 1).otherwise(2).alias("depth"),
        (n == 7).alias("is_deleted"),
        F.concat(F.lit("Node "), n.cast("string")).alias("display_label"),
        F.lit("ok").alias("status"),
        F.concat(F.lit("https://x/"), n.cast("string")).alias("url"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("alias"),
    )


def test_children_page(tree):
    page = B.children_page(tree, "s", "000000", offset=5, limit=3).orderBy("id").collect()
    assert [(r.id, r.total) for r in page] == [("000006", 99), ("000008", 99), ("000009", 99)]
    assert [r.id for r in B.children_page(tree, "s", None).collect()] == ["000000"]


def test_flat_and_search(tree):
    flat = B.flat_tree(tree, 5000)
    assert flat.count() == 5000 and flat.filter("not truncated or total <> 12000").count() == 0
    assert [r.id for r in B.search(tree, "NODE 1200").collect()] == ["001200", "012000"]
    assert B.search(tree, "node 12000", candidates=5000).count() == 0
    assert B.search(tree, "^node 1[0-9]$", regex=True, depth=1).count() == 10


def test_walks(tree):
    sub = G.subtree(tree, tree.filter("id = '000005'").select("id"), with_level=True)
    assert {(r.level, r["count"]) for r in sub.groupBy("level").count().collect()} == {(0, 1), (1, 100)}
    up = G.ancestors(tree, tree.filter("id = '000512'").select("id")).orderBy("distance").collect()
    assert [(r.ancestor, r.distance) for r in up] == [("000005", 1), ("000000", 2)]


def test_queue_rules(spark):
    queue = spark.createDataFrame(
        [(1, "t", "a", 0, "pending", None), (2, "t", "a", -1, "pending", None), (3, "t", "a", -1, "pending", 99), (4, "t", "b", -2, "pending", 5), (5, "t", "b", 0, "done", None)],
        "id long, task_id string, host string, priority int, state string, next_retry_at long",
    )
    assert [r.id for r in Q.queue_due(queue, 10).orderBy("id").collect()] == [1, 2, 4]
    assert {r.id for r in Q.frontier_pick(queue, 2, 1, 10).collect()} == {1, 4}
    slots = {r.id: (r.start_ms, r.slot) for r in Q.schedule(queue, 100, 2).collect()}
    assert slots == {1: (0, 0), 2: (100, 1), 3: (200, 0), 5: (0, 0), 4: (100, 1)}
    spread = Q.schedule(queue, 100, 2, jitter_ms=50)
    assert spread.filter("start_ms < (case when id in (1, 5) then 0 when id in (2, 4) then 100 else 200 end)").count() == 0
    tasks = spark.createDataFrame([("a", "running"), ("b", "done")], "id string, status string")
    assert {r.id: r.status for r in Q.recover_tasks(tasks).collect()} == {"a": "paused", "b": "done"}


def test_probe_and_content_class(spark):
    probes = spark.createDataFrame(
        [(0, False, False, None, None), (1, True, True, 200, "text/html"), (2, True, True, 404, "text/html"), (3, True, False, 200, None), (4, True, False, 200, "image/png")],
        "i int, reachable boolean, is_html boolean, http_status int, content_type string",
    )
    got = [(r.probe_status, r.accept) for r in S.probe_status(probes).orderBy("i").collect()]
    assert got == [("error", True), ("ok", True), ("error", True), ("queued", True), ("error", False)]
    kinds = spark.createDataFrame([(None,), ("Text/HTML; x",), ("application/pdf",), ("text/plain",), ("application/json",)], "c string")
    assert [r.k for r in kinds.select(H.content_class(F.col("c")).alias("k")).collect()] == ["html", "html", "asset", "html", "other"]
