"""Node and edge tables: discovery, deduplication, upserts and walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import with_row_number
from ..plans.stage import discard, is_empty, staged
from .tour import climbed


def resolve_targets(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``to_id`` to links (site_id, target_identity, target_url): identity first, else url."""
    by_key = (
        nodes.groupBy(F.col("site_id").alias("_s1"), F.col("identity_key").alias("_k"))
        .agg(F.min("id").alias("_id1"))
    )
    by_url = (
        nodes.groupBy(F.col("site_id").alias("_s2"), F.col("url").alias("_u"))
        .agg(F.min("id").alias("_id2"))
    )
    return (
        links.join(by_key, (F.col("site_id") == F.col("_s1")) & (F.col("target_identity") == F.col("_k")), "left")
        .join(by_url, (F.col("site_id") == F.col("_s2")) & (F.col("target_url") == F.col("_u")), "left")
        .select(*[links[c] for c in links.columns], F.coalesce("_id1", "_id2").alias("to_id"))
    )


def first_discovery(links: DataFrame) -> DataFrame:
    """First parent and lowest depth per discovered identity.

    Input: site_id, identity_key, from_id, from_rank, order_in_page, depth.
    """
    found = F.struct("from_rank", "order_in_page")
    return links.groupBy("site_id", "identity_key").agg(
        F.min_by("from_id", found).alias("auto_parent_id"),
        F.min("depth").alias("depth"),
        F.min(found).alias("first_found"),
    )


def bfs_rank(discoveries: DataFrame) -> DataFrame:
    """Queue order per site: shallow first, then by discovery."""
    return with_row_number(discoveries, ["site_id"], ["depth", "parent_rank", "order_in_page"], "bfs_rank")


def dedup_edges(links: DataFrame, order: Column) -> DataFrame:
    """First edge per (site, from, to, fragment); a NULL fragment is a value of its own.

    An aggregation, not a window: repeated links collapse before the shuffle.
    """
    keys = ["site_id", "from_id", "to_id", "fragment"]
    rest = [c for c in links.columns if c not in keys]
    return (
        links.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def trim_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select(F.col("id").alias("_id"))
    return edges.join(ids, F.col("from_id") == F.col("_id"), "left_semi").join(
        ids, F.col("to_id") == F.col("_id"), "left_semi"
    )


def apply_redirects(nodes: DataFrame, redirects: DataFrame) -> DataFrame:
    """Nodes take the final url and identity of their redirect.

    ``redirects``: site_id, node_id, final_url, final_identity, seq.  When the
    identity already has an owner (a node, or an earlier redirect) only the url
    changes.  Of several redirects of one node the last counts.
    """
    rest = [c for c in redirects.columns if c != "node_id"]
    redirects = redirects.groupBy("node_id").agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select("node_id", "_r.*")
    owned = nodes.groupBy(F.col("site_id").alias("_s"), F.col("identity_key").alias("_k")).agg(F.min("id").alias("_owner"))
    winners = redirects.groupBy(
        F.col("site_id").alias("_ws"), F.col("final_identity").alias("_wk")
    ).agg(F.min_by("node_id", "seq").alias("_winner"))
    moves = (
        redirects.join(owned, (F.col("site_id") == F.col("_s")) & (F.col("final_identity") == F.col("_k")), "left")
        .join(winners, (F.col("site_id") == F.col("_ws")) & (F.col("final_identity") == F.col("_wk")), "left")
        .select(
            F.col("node_id").alias("_node"),
            "final_url",
            F.when(
                F.coalesce(F.col("_owner") == F.col("node_id"), F.col("_winner") == F.col("node_id")),
                F.col("final_identity"),
            ).alias("_new_key"),
        )
    )
    replaced = {
        "url": F.coalesce("final_url", nodes["url"]),
        "identity_key": F.coalesce("_new_key", nodes["identity_key"]),
    }
    return nodes.join(moves, nodes["id"] == F.col("_node"), "left").select(
        *[replaced.get(c, nodes[c]).alias(c) for c in nodes.columns]
    )


def redirect_edges(redirects: DataFrame, edges: DataFrame) -> DataFrame:
    """New ``source='redirect'`` edges (site_id, from_id, to_id) not present without a fragment."""
    present = edges.filter(F.col("fragment").isNull()).select(
        F.col("from_id").alias("_f"), F.col("to_id").alias("_t")
    )
    return (
        redirects.select("site_id", "from_id", "to_id")
        .distinct()
        .join(present, (F.col("from_id") == F.col("_f")) & (F.col("to_id") == F.col("_t")), "left_anti")
        .withColumn("source", F.lit("redirect"))
    )


def upsert_nodes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-or-ignore on (site, identity); a later, shallower sighting lowers the depth.

    ``new`` carries ``found_seq``; all other columns as in ``existing``.
    """
    rest = [c for c in existing.columns if c not in ("site_id", "identity_key", "depth")]
    both = existing.withColumn("found_seq", F.lit(-1).cast("long")).unionByName(new)
    return (
        both.groupBy("site_id", "identity_key")
        .agg(F.min_by(F.struct(*rest), "found_seq").alias("_r"), F.min("depth").alias("depth"))
        .select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in existing.columns])
    )


def upsert_materials(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Latest bytes/sha256 per (node, kind, rel_path); the first id stays."""
    keys = ["site_id", "node_id", "kind", "rel_path"]
    rest = [c for c in existing.columns if c not in (*keys, "id")]
    return (
        existing.unionByName(new)
        .groupBy(*keys)
        .agg(F.min("id").alias("id"), F.max_by(F.struct(*rest), "id").alias("_r"))
        .select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in existing.columns])
    )


# ---- walks --------------------------------------------------------------


def children_relation(effective: DataFrame) -> DataFrame:
    return effective.filter(F.col("effective_parent_id").isNotNull()).select(
        F.col("effective_parent_id").alias("parent"), F.col("id").alias("child")
    )


def reachable(seeds: DataFrame, relation: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """All (root, id, level) reachable from ``seeds`` (root, id) over (parent, child).

    Set semantics, safe on cycles: each round joins the newest level only and
    drops what was seen.  Every round is one written table.  Four tables of one
    size class are merged into one of the next, so a plan reads a number of
    tables that is logarithmic in the depth, and a row is rewritten as often.
    """
    level = staged(seeds.select("root", "id").distinct().withColumn("level", F.lit(0)), "reach")
    seen: list[tuple[int, DataFrame]] = [(0, level)]
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        step = (
            level.join(relation, level["id"] == relation["parent"])
            .select("root", F.col("child").alias("id"))
            .distinct()
        )
        known = _all(seen).select("root", "id")
        level = staged(
            step.join(known, ["root", "id"], "left_anti").withColumn("level", F.lit(rounds)), "reach"
        )
        if is_empty(level):
            break
        seen.append((0, level))
        while len(seen) >= 5 and len({rank for rank, _ in seen[-5:-1]}) == 1 and seen[-1][0] <= seen[-2][0]:
            # the newest table stays apart: the next round reads it
            parts = seen[-5:-1]
            merged = staged(_all(parts), "reach")
            seen[-5:-1] = [(parts[0][0] + 1, merged)]
            discard(*[df for _, df in parts])
    return _all(seen)


def _all(tables: list[tuple[int, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df for _, df in tables])


def subtree(effective: DataFrame, roots: DataFrame, with_level: bool = False, live_only: bool = False) -> DataFrame:
    """Descendants of ``roots`` (id), roots included.

    ``live_only`` skips base-deleted children, as the correction service does;
    exports walk through deleted nodes.
    """
    source = effective.filter(~F.col("base_deleted")) if live_only else effective
    relation = staged(children_relation(source), "children")
    out = reachable(roots.select(F.col("id").alias("root"), "id"), relation)
    return out if with_level else out.drop("level")


def ancestors(effective: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, distance) of the asked nodes (all, if none are named) by effective parents; cycles stop the climb."""
    return climbed(effective, effective if seeds is None else seeds)
