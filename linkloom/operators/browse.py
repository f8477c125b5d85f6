"""Reading the tree: pages of children, search, details, latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import first_n, with_row_number
from .tour import labelled


def children_page(effective: DataFrame, site_id: str, parent: str | None, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of live effective children, with the total."""
    owner = F.col("effective_parent_id").isNull() if parent is None else F.col("effective_parent_id") == parent
    rows = effective.filter((F.col("site_id") == site_id) & owner & ~F.col("is_deleted"))
    total = rows.groupBy("site_id").agg(F.count("*").alias("total"))
    return rows.orderBy("depth", "id").offset(offset).limit(limit).join(total, "site_id")


def children_pages(effective: DataFrame, page_size: int = 100) -> DataFrame:
    """All children with page number, for every parent at once."""
    live = effective.filter(~F.col("is_deleted"))
    ranked = with_row_number(live, ["site_id", "effective_parent_id"], ["depth", "id"], "_rn")
    place = F.col("_rn") - 1
    return ranked.select(
        "site_id",
        "effective_parent_id",
        "id",
        F.floor(place / page_size).cast("int").alias("page"),
        (place % page_size).alias("pos"),
    )


def flat_tree(effective: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` live nodes per site by (depth, id), with total and truncated flag."""
    live = effective.filter(~F.col("is_deleted"))
    totals = live.groupBy("site_id").agg(F.count("*").alias("total"))
    return (
        first_n(live, ["site_id"], ["depth", "id"], limit)
        .join(totals, "site_id")
        .withColumn("truncated", F.col("total") > limit)
    )


def search(
    effective: DataFrame,
    q: str,
    *,
    depth: int | None = None,
    status: str | None = None,
    regex: bool = False,
    limit: int | None = 100,
    candidates: int | None = None,
) -> DataFrame:
    """Live nodes whose url, label, title or alias contain ``q`` (or match it as a regex), with ``total`` hits.

    All nodes are scanned; ``candidates`` restores a first-n-by-depth cut.
    ``limit`` is the length of the list, None for all.  A pattern that is no
    regular expression raises ValueError before anything is read.
    """
    if regex:
        _check_pattern(effective, q)
    rows = effective.filter(~F.col("is_deleted"))
    if depth is not None:
        rows = rows.filter(F.col("depth") == depth)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if candidates is not None:
        rows = rows.orderBy("depth", "id").limit(candidates)
    fields = ("url", "display_label", "title", "alias")
    if regex:
        hits = [F.coalesce(F.col(f).rlike("(?i)" + q), F.lit(False)) for f in fields]
    else:
        hits = [F.coalesce(F.contains(F.lower(f), F.lit(q.lower())), F.lit(False)) for f in fields]
    matched = hits[0] | hits[1] | hits[2] | hits[3]
    found = rows.filter(matched)
    listed = found.orderBy("depth", "id") if limit is None else found.orderBy("depth", "id").limit(limit)
    total = found.groupBy(F.lit(1).alias("_one")).agg(F.count("*").alias("total"))
    return listed.withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")


def _check_pattern(df: DataFrame, pattern: str) -> None:
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile("(?i)" + pattern)
    except Exception as error:
        raise ValueError(f"not a regular expression: {pattern}") from error


def materials_list(materials: DataFrame, site_id: str, node_id: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Files of a site by id; ``limit`` is the length of the list, None for all."""
    rows = materials.filter(F.col("site_id") == site_id)
    if node_id is not None:
        rows = rows.filter(F.col("node_id") == node_id)
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    return rows.orderBy("id") if limit is None else rows.orderBy("id").limit(limit)


def latest_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Latest ``n`` rows per key; order columns are given as ``-col`` for newest first."""
    return first_n(df, keys, order, n)


def deepest(nodes: DataFrame, n: int = 10) -> DataFrame:
    return nodes.orderBy(F.col("depth").desc(), F.col("id")).limit(n)


def list_sites(sites: DataFrame, archived: bool | None = False) -> DataFrame:
    rows = sites if archived is None else sites.filter(F.col("archived") == archived)
    return rows.orderBy(F.col("updated_at").desc(), F.col("id").desc())


def roots(nodes: DataFrame) -> DataFrame:
    """Root of each site: parentless, live, shallowest, earliest seen."""
    return (
        nodes.filter(F.col("auto_parent_id").isNull() & ~F.col("is_deleted"))
        .groupBy("site_id")
        .agg(F.min_by("id", F.struct("depth", "first_seen_at", "id")).alias("id"))
    )


def existing_roots(candidates: DataFrame, sites: DataFrame) -> DataFrame:
    """Candidates (identity_key) whose root is already an unarchived site."""
    live = sites.filter(~F.col("archived")).select("identity_key").distinct()
    return candidates.join(live, "identity_key", "left_semi")


def tree_links(effective: DataFrame) -> DataFrame:
    """parent → child pairs with the parent in the set."""
    ids = effective.select(F.col("id").alias("_id"))
    return effective.join(ids, F.col("effective_parent_id") == F.col("_id"), "left_semi").select(
        F.col("effective_parent_id").alias("from_id"), F.col("id").alias("to_id")
    )


def node_detail(effective: DataFrame, edges: DataFrame, overrides: DataFrame, materials: DataFrame,
                max_in: int = 200, max_out: int = 500, max_history: int = 50) -> DataFrame:
    """Neighbours, materials and history of every node as one long table (node_id, part, pos_key, item)."""
    label = effective.select(F.col("id").alias("_n"), F.col("display_label").alias("_label"))
    incoming = first_n(edges, ["to_id"], ["id"], max_in).select(
        F.col("to_id").alias("node_id"), F.col("from_id").alias("other"), F.col("id").alias("pos_key")
    )
    outgoing = first_n(edges, ["from_id"], ["order_in_page", "id"], max_out).select(
        F.col("from_id").alias("node_id"), F.col("to_id").alias("other"), F.col("id").alias("pos_key")
    )

    def with_label(df: DataFrame, part: str) -> DataFrame:
        return df.join(label, df["other"] == label["_n"]).select(
            "node_id", F.lit(part).alias("part"), "pos_key", F.concat_ws("|", "other", "_label").alias("item")
        )

    files = materials.select(
        "node_id", F.lit("material").alias("part"), F.col("id").alias("pos_key"), F.concat_ws("|", "kind", "rel_path").alias("item")
    )
    history = first_n(overrides, ["node_id"], ["-seq", "-id"], max_history).select(
        "node_id", F.lit("override").alias("part"), F.col("id").alias("pos_key"), F.concat_ws("|", "field", "value").alias("item")
    )
    return with_label(incoming, "in").unionByName(with_label(outgoing, "out")).unionByName(files).unionByName(history)


def indent_order(nodes: DataFrame) -> DataFrame:
    """Forest in preorder: (id, parent_id, label) → id, label, level, is_last, line, loop.

    Siblings by label, then id; a node whose parent is outside the set is a
    root.  ``line`` numbers the listing.  A cycle of parents is listed below its
    smallest id, and its nodes carry that id as ``loop``.
    """
    places = labelled(nodes, "parent_id", ("label", "id"))
    rows = places.join(nodes.select("id", "label"), "id")
    lasts = rows.groupBy("parent").agg(F.max("place").alias("_last"))
    met = rows.join(lasts, rows["parent"].eqNullSafe(lasts["parent"]))
    return met.select("id", "label", F.col("depth").cast("int").alias("level"), (F.col("place") == F.col("_last")).alias("is_last"), F.col("place").alias("line"), "loop").orderBy("line")
