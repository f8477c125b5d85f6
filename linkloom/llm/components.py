"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _minima(pairs: DataFrame) -> DataFrame:
    return staged(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "minima")


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns ``a``, ``b``); root is the smallest node reachable.

    Minima are aggregated before the shuffle and written, so the join that
    follows reads two plain exchanges, and AQE can split a hot node.  Rounds are
    Parquet tables in the shared folder.  Loops and repeated edges are allowed;
    edges with a NULL end are ignored.  No edges give an empty result.
    """
    current = staged(
        edges.filter("a is not null and b is not null")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .filter("u <> v")
        .distinct(),
        "edges",
    )
    fingerprint = None
    for _ in range(max_rounds):
        # Large star: larger neighbours of a node are tied to its smallest neighbour.
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        minima = _minima(both)
        large = staged(both.join(minima, "u").filter("v > u").select(F.col("m").alias("u"), "v").distinct(), "large")
        # Small star: smaller neighbours of a node, and the node, are tied to the smallest of them.
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        lowest = _minima(down)
        small = staged(
            down.join(lowest, "u")
            .select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u"))
            .filter("u <> v")
            .distinct(),
            "small",
        )
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(current, minima, large, lowest)
        current = small
        if state == fingerprint:
            break
        fingerprint = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        current.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )
