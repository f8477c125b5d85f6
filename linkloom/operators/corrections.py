"""The correction log: timeline, moves, deletes, trash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import running
from ..plans.stage import by_merge
from .tour import along_paths, labelled, live_tree


def op_state():
    return F.when(F.col("discarded"), "discarded").when(F.col("undone"), "redoable").otherwise("applied")


def timeline(ops: DataFrame) -> DataFrame:
    """Operations with their state; order by (site_id, seq, id)."""
    return ops.withColumn("state", op_state())


def stack_tops(ops: DataFrame) -> DataFrame:
    """Undo top (last applied) and redo top (first redoable) per site."""
    t = timeline(ops)
    at = F.struct("seq", "id")
    return t.groupBy("site_id").agg(
        F.max_by("op_group", F.when(F.col("state") == "applied", at)).alias("undo_top"),
        F.min_by("op_group", F.when(F.col("state") == "redoable", at)).alias("redo_top"),
    )


def op_chain(ops: DataFrame) -> DataFrame:
    """prev_op_group = the operation before it (a batch of appends without undo)."""
    last = {"_prev": ("max", F.struct("seq", "id", "op_group"))}
    out = running(ops, ["site_id"], ["seq", "id"], last, exclusive=True)
    return out.withColumn("prev_op_group", F.col("_prev.op_group")).drop("_prev")


def op_summary(ops: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rows written by each operation."""
    counts = overrides.groupBy(F.col("op_group").alias("_g")).agg(F.count("*").alias("_n"))
    return ops.join(counts, ops["op_group"] == counts["_g"], "left").select(
        "site_id", "op_group", "kind", "seq", F.coalesce("_n", F.lit(0)).alias("row_count")
    )


def stack_depths(ops: DataFrame) -> DataFrame:
    t = timeline(ops)
    return t.groupBy("site_id").agg(
        F.count_if(F.col("state") == "applied").alias("undo_depth"),
        F.count_if(F.col("state") == "redoable").alias("redo_depth"),
    )


def next_seq(overrides: DataFrame, ops: DataFrame) -> DataFrame:
    """Next sequence number per site over both logs."""
    return (
        overrides.select("site_id", "seq")
        .unionByName(ops.select("site_id", "seq"))
        .groupBy("site_id")
        .agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))
    )


def op_nodes(ops: DataFrame, overrides: DataFrame) -> DataFrame:
    """Nodes touched by each operation: payload rows for reverts, written rows otherwise."""
    rows = overrides.select("id", "node_id", F.col("op_group").alias("_g"))
    reverted = (
        ops.filter(F.col("kind") == "reverted")
        .select("op_group", F.explode("payload").alias("_id"))
        .join(rows, F.col("_id") == rows["id"])
        .select("op_group", "node_id")
    )
    written = (
        ops.filter(F.col("kind") != "reverted")
        .select("op_group")
        .join(rows, F.col("op_group") == F.col("_g"))
        .select("op_group", "node_id")
    )
    return reverted.unionByName(written).distinct()


def validate_moves(effective: DataFrame, moves: DataFrame) -> DataFrame:
    """Verdict per move (site_id, node_id, new_parent_id).

    ok / no_change / not_found / parent_not_found / self / descendant.  Whether
    the new parent is below the node is told by their places in the tree.
    """
    nodes = effective.select(F.col("id"), F.col("site_id").alias("_site"), "effective_parent_id")
    n = nodes.select(F.col("id").alias("_n"), F.col("_site").alias("_ns"), F.col("effective_parent_id").alias("_cur"))
    t = nodes.select(F.col("id").alias("_t"), F.col("_site").alias("_ts"))
    places = labelled(effective).select("id", "place", "low", "high")
    own = places.select(F.col("id").alias("_own"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    goal = places.select(F.col("id").alias("_goal"), F.col("place").alias("_place"))
    joined = (
        moves.join(by_merge(n), (F.col("node_id") == F.col("_n")) & (F.col("site_id") == F.col("_ns")), "left")
        .join(by_merge(t), (F.col("new_parent_id") == F.col("_t")) & (F.col("site_id") == F.col("_ts")), "left")
        .join(by_merge(own), F.col("node_id") == F.col("_own"), "left")
        .join(by_merge(goal), F.col("new_parent_id") == F.col("_goal"), "left")
    )
    verdict = (
        F.when(F.col("new_parent_id").isNotNull() & F.col("_t").isNull(), "parent_not_found")
        .when(F.col("_n").isNull(), "not_found")
        .when(F.coalesce(F.col("new_parent_id") == F.col("node_id"), F.lit(False)), "self")
        .when(F.col("_place").between(F.col("_low"), F.col("_high")), "descendant")
        .when(F.col("new_parent_id").eqNullSafe(F.col("_cur")), "no_change")
        .otherwise("ok")
    )
    return joined.select(
        *[moves[c] for c in moves.columns], verdict.alias("verdict"), F.col("_cur").alias("prev_value")
    )


def delete_subtrees(effective: DataFrame, ids: DataFrame, op_group: str, seq: int) -> DataFrame:
    """Override rows that delete the subtrees of ``ids`` (id, pos).

    An id below another id of an earlier position adds nothing of its own.
    ``effective`` carries ``base_deleted``; base-deleted children are not walked.
    """
    labels = labelled(effective)
    asked = ids.groupBy(F.col("id").alias("_asked")).agg(F.min("pos").alias("pos"))
    placed = labels.join(by_merge(asked), F.col("id") == F.col("_asked"), "left")
    # the first position asked for anywhere above; on a cycle every node is above the others
    first = placed.join(by_merge(along_paths(placed.select("id", "parent", "pos"), least=("min", F.col("pos")))), "id")
    rings = placed.filter("loop is not null").groupBy(F.col("loop").alias("_loop")).agg(F.min("pos").alias("_ring"))
    around = first.join(by_merge(labels.select(F.col("id").alias("top"), F.col("loop").alias("_loop"))), "top", "left").join(by_merge(rings), "_loop", "left")
    roots = around.filter("pos is not null and least(least, _ring) = pos").select("id", F.lit(1).alias("hit"))
    live = labelled(live_tree(effective))
    marked = live.join(by_merge(roots), "id", "left")
    hit = marked.join(by_merge(along_paths(marked.select("id", "parent", "hit"), reached=("max", F.col("hit")))), "id")
    ringed = marked.filter("loop is not null").groupBy(F.col("loop").alias("_top")).agg(F.max("hit").alias("_whole"))
    hit = hit.join(by_merge(ringed), F.col("top") == F.col("_top"), "left").filter("reached = 1 or _whole = 1").select("id")
    return hit.join(by_merge(effective), "id").select(
        "site_id",
        F.col("id").alias("node_id"),
        F.lit("deleted").alias("field"),
        F.lit("1").alias("value"),
        F.col("is_deleted").cast("int").cast("string").alias("prev_value"),
        F.lit(op_group).alias("op_group"),
        F.lit(seq).cast("long").alias("seq"),
        F.lit(False).alias("undone"),
    )


def trash_roots(effective: DataFrame, overrides: DataFrame) -> DataFrame:
    """Live ``deleted='1'`` rows whose node's effective parent has no such row."""
    rows = overrides.filter((F.col("field") == "deleted") & (F.col("value") == "1") & ~F.col("undone"))
    rows = rows.select("node_id", "op_group", "seq")
    parents = effective.select(F.col("id").alias("node_id"), "site_id", "effective_parent_id")
    gone = rows.select(F.col("node_id").alias("_gone")).distinct()
    return (
        rows.join(by_merge(parents), "node_id")
        .join(by_merge(gone), F.col("effective_parent_id") == F.col("_gone"), "left_anti")
        .select("site_id", "node_id", "op_group", "seq")
    )


def trash_view(effective: DataFrame, overrides: DataFrame) -> DataFrame:
    """Trash roots with label and the number of nodes a restore touches."""
    roots = trash_roots(effective, overrides)
    sizes = labelled(live_tree(effective)).select(F.col("id").alias("node_id"), F.col("size").alias("affected_nodes"))
    labels = effective.select(F.col("id").alias("node_id"), "display_label")
    return roots.join(by_merge(labels), "node_id").join(by_merge(sizes), "node_id")


def delete_impact(effective: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes touched by deleting or restoring each id."""
    return ids.select("id").distinct().join(by_merge(labelled(live_tree(effective)).select("id", F.col("size").alias("affected_nodes"))), "id")
