"""Interval labels of a forest: position in preorder, depth and size of every subtree.

Everything along a path is found by pointer doubling: a round joins each node
with the node it points at, so pointers span 1, 2, 4, … levels and the number of
jobs grows with the logarithm of the depth.  "Is below" is then a comparison of
numbers and a subtree's size is a column; no pairs of ancestors are made.

A cycle of parents has no top.  Its node with the smallest id is taken for one
(``loop``), so every node has a place; all nodes of a cycle are above each other
and cover the same interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import running
from ..plans.stage import by_merge, discard, staged


def forest(nodes: DataFrame, parent: str, *extra: str) -> DataFrame:
    """(id, parent, extra columns), written; a parent that is not among the ids counts as none."""
    ids = nodes.select(F.col("id").alias("_known")).distinct()
    met = nodes.select("id", F.col(parent).alias("_parent"), *extra).join(by_merge(ids), F.col("_parent") == F.col("_known"), "left")
    return staged(met.select("id", F.col("_known").alias("parent"), *extra), "forest")


def along_paths(tree: DataFrame, **values: tuple[str, Column]) -> DataFrame:
    """(id, values): each ``("sum" | "min" | "max", value)`` over a node and all nodes above it; ``tree`` must have no cycle.

    NULL values are passed over.
    """
    combine = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
    state = staged(tree.select("id", F.col("parent").alias("up"), *[c.alias(n) for n, (_, c) in values.items()]), "paths")
    while state.filter("up is not null").take(1):
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), *[F.col(n).alias(f"_{n}") for n in values])
        merged = [combine[how](F.col(n), F.col(f"_{n}")).alias(n) for n, (how, _) in values.items()]
        onward = state.filter("up is not null").join(by_merge(above), "up", "left").select("id", F.col("_up").alias("up"), *merged)
        further = staged(onward.unionByName(state.filter("up is null")), "paths")
        discard(state)
        state = further
    return state.drop("up")


def _measured(tree: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, depth, size, top), or the nodes of cycles as (id, loop) if there are any."""
    one = F.lit(1).cast("bigint")
    state = staged(tree.select("id", F.col("parent").alias("up"), F.coalesce("parent", "id").alias("top"), F.col("parent").isNotNull().cast("bigint").alias("depth"), F.least("id", "parent").alias("least"), one.alias("size")), "measure")
    span, before = 1, None
    while True:
        open_ = state.filter("up is not null").agg(F.count("*").alias("n"), F.count_distinct("up").alias("ups")).first()
        if not open_.n:
            return state.select("id", "depth", "size", "top"), None
        # the same nodes still climb, and lead to the same ones, no more of them than the pointers span: only cycles are left
        if before == tuple(open_) and span >= open_.ups:
            members = state.filter("up is not null").select("up").distinct()
            return state, staged(state.join(by_merge(members.select(F.col("up").alias("id"))), "id").select("id", F.col("least").alias("loop")), "cycles")
        before = tuple(open_)
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("depth").alias("_depth"), F.col("least").alias("_least"))
        below = state.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("_size"))
        onward = state.filter("up is not null").join(by_merge(above), "up", "left")
        onward = onward.unionByName(state.filter("up is null"), allowMissingColumns=True)
        further = onward.join(by_merge(below), "id", "left").select(
            "id", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            F.least("least", "_least").alias("least"), (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"),
        )
        further = staged(further, "measure")
        discard(state)
        state, span = further, 2 * span


def labelled(nodes: DataFrame, parent: str = "effective_parent_id", order: tuple[str, ...] = ("id",)) -> DataFrame:
    """(id, parent, top, depth, size, place, low, high, loop) of every node.

    ``place`` numbers the nodes in preorder from 1, siblings and tops by ``order``.
    Node u is below v if ``low(v) <= place(u) <= high(v)`` and u is not v.
    ``size`` counts the node and all below; ``loop`` is NULL outside cycles.
    """
    tree = forest(nodes, parent, *[c for c in order if c != "id"])
    measured, cycles = _measured(tree)
    if cycles is not None:
        cut = cycles.filter("id = loop").select(F.col("id").alias("_cut"))
        kept = tree.join(by_merge(cut), F.col("id") == F.col("_cut"), "left")
        tree = staged(kept.withColumn("parent", F.when(F.col("_cut").isNull(), F.col("parent"))).drop("_cut"), "forest")
        measured, _ = _measured(tree)
    sized = staged(tree.join(by_merge(measured), "id"), "sized")
    # a node stands behind its parent and the subtrees of its earlier siblings
    earlier = running(sized, ["parent"], list(order), {"_before": ("sum", F.col("size"))}, exclusive=True)
    offset = earlier.select("id", "parent", (1 + F.coalesce("_before", F.lit(0))).alias("offset"))
    out = sized.join(by_merge(along_paths(offset, place=("sum", F.col("offset")))), "id")
    out = out.select("id", "parent", "top", "depth", "size", "place", F.col("place").alias("low"), (F.col("place") + F.col("size") - 1).alias("high"))
    if cycles is None:
        return staged(out.withColumn("loop", F.lit(None).cast(dict(out.dtypes)["id"])), "labels")
    out = staged(out, "labels").join(by_merge(cycles), "id", "left")
    tops = out.filter("id = loop").select(F.col("id").alias("loop"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("size").alias("_size"))
    whole = out.join(by_merge(tops), "loop", "left")
    return staged(whole.select("id", "parent", "top", "depth", F.coalesce("_size", "size").alias("size"), "place", F.coalesce("_low", "low").alias("low"), F.coalesce("_high", "high").alias("high"), "loop"), "labels")


def live_tree(effective: DataFrame) -> DataFrame:
    """``effective`` with base-deleted nodes hanging below nothing, as walks of live nodes see it."""
    return effective.select("id", F.when(~F.col("base_deleted"), F.col("effective_parent_id")).alias("effective_parent_id"))


def climbed(effective: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, ancestor, distance) of the asked nodes (id), nearest first on cycles, by doubling."""
    jumps = staged(effective.filter("effective_parent_id is not null").select(F.col("id").alias("at"), F.col("effective_parent_id").alias("to")), "jumps")
    found = seeds.select(F.col("id").alias("node"), F.col("id").alias("ancestor"), F.lit(0).cast("int").alias("distance")).distinct()
    span = 1
    while True:
        more = found.join(by_merge(jumps), F.col("ancestor") == F.col("at")).select("node", F.col("to").alias("ancestor"), (F.col("distance") + span).alias("distance"))
        more = staged(more.join(by_merge(found.select("node", "ancestor")), ["node", "ancestor"], "left_anti").groupBy("node", "ancestor").agg(F.min("distance").alias("distance")), "climbed")
        if not more.take(1):
            return found.filter("distance > 0")
        found = staged(found.unionByName(more), "climbed")
        onward = jumps.select(F.col("at").alias("to"), F.col("to").alias("far"))
        jumps = staged(jumps.join(by_merge(onward), "to").select("at", F.col("far").alias("to")), "jumps")
        span *= 2
