"""Ordered helpers against plain Python on skewed groups."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import corrections, layout
from linkloom.plans.ordered import first_n, running, running_walk, with_row_number
from linkloom.streaming import pairing


@pytest.fixture(scope="module")
def skewed(spark):
    # one group holds most rows; order has ties broken by id, and nulls
    return spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"),
        F.when(F.col("id") % 97 != 0, (F.col("id") * 7919) % 501).alias("a"),
        F.md5(F.col("id").cast("string")).alias("s"),
        F.col("id"),
    )


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def in_order(df, order):
    """Rows of each group in order, nulls last either way."""
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r)
    for own in groups.values():
        for name in reversed(order):
            own.sort(key=lambda r: r[name.lstrip("-")] if r[name.lstrip("-")] is not None else "" if name.endswith("s") else -1, reverse=name.startswith("-"))
            own.sort(key=lambda r: r[name.lstrip("-")] is None)
    return groups


@pytest.mark.parametrize("order", [["a", "id"], ["-a", "s"], ["s"]])
def test_row_number(skewed, order):
    want = sorted((r.id, n) for own in in_order(skewed, order).values() for n, r in enumerate(own, 1))
    assert sorted(map(tuple, with_row_number(skewed, ["g"], order, partitions=7).select("id", "rn").collect())) == want


@pytest.mark.parametrize("exclusive", [False, True])
def test_running(skewed, exclusive):
    aggs = {"total": ("sum", F.col("id")), "low": ("min", F.col("id")), "top": ("max", F.struct("a", "id"))}
    got = {r.id: (r.total, r.low) for r in running(skewed, ["g"], ["a", "id"], aggs, exclusive=exclusive, partitions=9).collect()}
    want = {}
    for own in in_order(skewed, ["a", "id"]).values():
        for n, r in enumerate(own):
            before = [x.id for x in own[: n if exclusive else n + 1]]
            want[r.id] = (sum(before), min(before)) if before else (None, None)
    assert got == want


def test_one_group_is_many_tasks_work(spark):
    """No window sorts the group in one task: the plan deals it out by range first."""
    df = with_row_number(spark.range(1000).withColumn("g", F.lit("one")), ["g"], ["id"], partitions=8)
    windows = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in x and "row_number" not in x and "_l_" in x]
    assert all("_part" in x for x in windows) and df.count() == 1000


@pytest.mark.parametrize("n", [3, 1500])
def test_first_n(skewed, n):
    got = {(r.g, r.id) for r in first_n(skewed, ["g"], ["id"], n).collect()}
    want = set()
    for g in {r.g for r in skewed.select("g").distinct().collect()}:
        ids = sorted(r.id for r in skewed.filter(F.col("g") == g).collect())
        want |= {(g, i) for i in ids[:n]}
    assert got == want


def test_operators_on_hot_groups(spark):
    ops = spark.range(300).select("id", F.lit("s").alias("site_id"), F.col("id").alias("seq"), F.concat(F.lit("g"), F.col("id")).alias("op_group"))
    assert {r.id: r.prev_op_group for r in corrections.op_chain(ops).collect()} == {i: f"g{i - 1}" if i else None for i in range(300)}
    nodes = spark.range(300).select(F.lit("s").alias("site_id"), F.lpad("id", 5, "0").alias("id"), F.lit(1).alias("depth"), F.lit(None).cast("string").alias("parent_id"))
    xs = [r.x for r in layout.layered_layout(nodes).orderBy("id").collect()]
    assert xs == sorted(xs) and len(set(xs)) == 300


def test_bursts_on_hot_session(spark):
    events = spark.range(500).select(
        F.lit("s").alias("session_id"), (F.col("id") * F.when(F.col("id") % 40 < 20, 10).otherwise(900)).alias("at_ms"), F.col("id").alias("event_id")
    )
    got = {r.event_id: r.burst for r in pairing.bursts(events, 100).collect()}
    last, start = None, None
    for r in sorted(events.collect(), key=lambda r: (r.at_ms, r.event_id)):
        start = r.at_ms if last is None or r.at_ms - last > 100 else start
        last = r.at_ms
        assert got[r.event_id] == start


def test_walk_that_may_not_fall_below_zero(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("aaab"), i, rnd.choice([1, -1, -1, 0, 2])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, step long")
    got = {r.i: r.total - min(r.lowest, r.total) for r in running_walk(df, ["g"], ["i"], F.col("step")).collect()}
    for g in "ab":
        at = 0
        for _, i, step in (r for r in rows if r[0] == g):
            at = max(0, at + step)
            assert got[i] == at
    assert running_walk(df.limit(0), ["g"], ["i"], F.col("step")).count() == 0
