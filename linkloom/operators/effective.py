"""The corrected view of nodes: base values overlaid by the latest live override.

One aggregation of the override log plus one join replaces a lookup per node
and field.  The aggregation combines before the shuffle, so a node with a huge
history costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import by_merge

FIELDS = ("parent", "url", "alias", "title", "deleted")


def _recency() -> Column:
    return F.struct("seq", "id")


def latest_overrides(overrides: DataFrame) -> DataFrame:
    """Latest live row per (node, field)."""
    rest = [c for c in overrides.columns if c not in ("node_id", "field")]
    return (
        overrides.filter(~F.col("undone"))
        .groupBy("node_id", "field")
        .agg(F.max_by(F.struct(*rest), _recency()).alias("_r"))
        .select("node_id", "field", *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def override_values(overrides: DataFrame) -> DataFrame:
    """One row per corrected node: latest live value of each field, and whether it is set."""
    live = overrides.filter(~F.col("undone"))
    aggs = []
    for name in FIELDS:
        when = F.when(F.col("field") == name, _recency())
        aggs.append(F.max_by("value", when).alias(f"ov_{name}"))
        aggs.append(F.max(F.col("field") == name).alias(f"set_{name}"))
    return live.groupBy("node_id").agg(*aggs)


def effective_nodes(nodes: DataFrame, overrides: DataFrame, null_is_value: bool = False) -> DataFrame:
    """Nodes with corrected columns, ``effective_parent_id`` and ``has_override``.

    A NULL override falls back to the base value (so moving to the root or
    clearing an alias has no effect) unless ``null_is_value``.
    """
    values = override_values(overrides)
    joined = nodes.join(by_merge(values), nodes["id"] == values["node_id"], "left")

    def pick(name: str, base: str) -> Column:
        over = F.col(f"ov_{name}")
        if null_is_value:
            return F.when(F.col(f"set_{name}"), over).otherwise(F.col(base))
        return F.coalesce(over, F.col(base))

    label = F.coalesce(
        F.nullif(F.col("ov_alias"), F.lit("")), F.nullif(F.col("ov_title"), F.lit("")), F.col("display_label")
    )
    replaced = {
        "url": pick("url", "url"),
        "alias": pick("alias", "alias"),
        "title": pick("title", "title"),
        "is_deleted": F.coalesce(F.col("ov_deleted") == "1", F.col("is_deleted")),
        "display_label": label,
    }
    return joined.select(
        *[replaced.get(c, F.col(c)).alias(c) for c in nodes.columns],
        pick("parent", "auto_parent_id").alias("effective_parent_id"),
        F.col("node_id").isNotNull().alias("has_override"),
        F.col("is_deleted").alias("base_deleted"),
    )


def with_has_override(nodes: DataFrame, overrides: DataFrame, field: str | None = None) -> DataFrame:
    """Flag nodes with any live override (of one field, if given)."""
    live = overrides.filter(~F.col("undone"))
    if field is not None:
        live = live.filter(F.col("field") == field)
    marked = live.select(F.col("node_id").alias("_marked")).distinct()
    return nodes.join(marked, nodes["id"] == F.col("_marked"), "left").select(
        *[nodes[c] for c in nodes.columns], F.col("_marked").isNotNull().alias("has_override")
    )


def with_child_count(effective: DataFrame) -> DataFrame:
    """Add ``child_count``: effective children that are not deleted."""
    counts = (
        effective.filter(~F.col("is_deleted") & F.col("effective_parent_id").isNotNull())
        .groupBy(F.col("effective_parent_id").alias("_parent"))
        .agg(F.count("*").alias("_n"))
    )
    return effective.join(counts, effective["id"] == counts["_parent"], "left").select(
        *[effective[c] for c in effective.columns], F.coalesce("_n", F.lit(0)).alias("child_count")
    )


def is_crawled(status: Column, last_fetch_at: Column) -> Column:
    """Fetched before; skipped and blocked nodes do not count."""
    return last_fetch_at.isNotNull() & status.isin("ok", "error", "need_human")
