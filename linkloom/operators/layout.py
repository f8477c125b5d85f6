"""Node positions for tree drawings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import with_row_number

# ---- fixed values: layered layout --------------------------------------
NODE_WIDTH, NODE_HEIGHT, GAP_X, GAP_Y, PADDING = 168, 30, 14, 26, 24
# -------------------------------------------------------------------------


def layered_layout(
    nodes: DataFrame,
    keys: tuple[str, ...] = ("site_id",),
    node_width: int = NODE_WIDTH,
    node_height: int = NODE_HEIGHT,
    gap_x: int = GAP_X,
    gap_y: int = GAP_Y,
    padding: int = PADDING,
) -> DataFrame:
    """Row per depth, ordered by (parent, id); ``nodes``: keys, id, parent_id, depth.

    A depth may hold most of a site, so its numbering is split over tasks.
    """
    filled = nodes.withColumn("_parent", F.coalesce("parent_id", F.lit("")))
    ranked = with_row_number(filled, [*keys, "depth"], ["_parent", "id"], "_rn")
    return ranked.select(
        *keys,
        "id",
        "depth",
        (F.lit(padding) + (F.col("_rn") - 1) * (node_width + gap_x)).alias("x"),
        (F.lit(padding) + F.col("depth") * (node_height + gap_y)).alias("y"),
    )


def layered_size(nodes: DataFrame, keys: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """Width and height of the layered drawing."""
    rows = nodes.groupBy(*keys, "depth").agg(F.count("*").alias("_n"))
    return rows.groupBy(*keys).agg(
        (2 * PADDING + F.greatest(F.max("_n"), F.lit(1)) * (NODE_WIDTH + GAP_X)).alias("width"),
        (2 * PADDING + F.greatest(F.count("*"), F.lit(1)) * (NODE_HEIGHT + GAP_Y)).alias("height"),
    )


def radial_layout(
    nodes: DataFrame, keys: tuple[str, ...] = ("site_id",), radius_step: int = 130, size: int = 900
) -> DataFrame:
    """Depth 0 in the centre, each depth on its own circle."""
    counts = nodes.groupBy(*keys, "depth").agg(F.count("*").alias("_n"))
    ranked = with_row_number(nodes, [*keys, "depth"], ["id"], "_rn")
    angle = (F.col("_rn") - 1) / F.col("_n") * 2 * math.pi
    radius = F.least(F.lit(size / 2 - 40), F.col("depth") * radius_step)
    centre = F.lit(size / 2)
    return ranked.join(counts, [*keys, "depth"]).select(
        *keys,
        "id",
        "depth",
        F.when(F.col("depth") == 0, centre).otherwise(centre + radius * F.cos(angle)).alias("x"),
        F.when(F.col("depth") == 0, centre).otherwise(centre + radius * F.sin(angle)).alias("y"),
    )
