"""Counts per site, task, page and prefix: map-side combined aggregations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def site_cards(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """Card figures per site; deleted nodes count only for ``last_fetch_at``."""
    live = ~F.col("is_deleted")
    root_order = F.when(live & F.col("auto_parent_id").isNull(), F.struct("depth", "first_seen_at", "id"))
    figures = nodes.groupBy("site_id").agg(
        F.count_if(live).alias("node_count"),
        F.count_if(live & (F.col("status") == "ok")).alias("ok_count"),
        F.count_if(live & (F.col("status") == "error")).alias("error_count"),
        F.max(F.when(live, F.col("depth"))).alias("max_depth"),
        F.max("last_fetch_at").alias("last_fetch_at"),
        F.min_by("status", root_order).alias("root_status"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return sites.join(figures, sites["id"] == figures["site_id"], "left").select(
        sites["id"].alias("site_id"),
        zero("node_count"),
        zero("ok_count"),
        zero("error_count"),
        zero("max_depth"),
        "last_fetch_at",
        "root_status",
    )


def status_distribution(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~F.col("is_deleted")).groupBy("site_id", "status").agg(F.count("*").alias("n"))


def depth_distribution(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~F.col("is_deleted")).groupBy("site_id", "depth").agg(F.count("*").alias("n"))


def fetch_ok() -> Column:
    return F.coalesce((F.col("http_status") < 400) & F.col("error").isNull(), F.lit(False))


def task_summary(logs: DataFrame) -> DataFrame:
    """ok = status below 400 without error; everything else failed."""
    return logs.groupBy("task_id").agg(
        F.count_if(fetch_ok()).alias("ok"),
        F.count_if(~fetch_ok()).alias("failed"),
        F.count("*").alias("fetched"),
    )


def in_link_count(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("to_id").alias("node_id")).agg(F.count("*").alias("in_link_count"))


def out_link_count(links: DataFrame, page_key: str) -> DataFrame:
    """All extracted links of a page, before scope and guards."""
    return links.groupBy(page_key).agg(F.count("*").alias("out_link_count"))


def identity_duplicates(nodes: DataFrame) -> DataFrame:
    """Identities stored more than once per site; empty on a sound table."""
    return (
        nodes.groupBy("site_id", "identity_key").agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)
    )


def visit_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("site_id", "identity_key").agg(
        F.count("*").alias("visits"), F.max("at").alias("last_at")
    )


def pagination_series(links: DataFrame) -> DataFrame:
    """Pages per series (site_id, series_key)."""
    return (
        links.filter(F.col("series_key").isNotNull())
        .groupBy("site_id", "series_key")
        .agg(F.count("*").alias("pages"))
    )


def table_counts(nodes: DataFrame, edges: DataFrame, materials: DataFrame) -> DataFrame:
    """Rows per site in the three tables."""
    parts = [
        df.groupBy("site_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(name))
        for name, df in (("nodes", nodes), ("edges", edges), ("materials", materials))
    ]
    return (
        parts[0].unionByName(parts[1]).unionByName(parts[2])
        .groupBy("site_id")
        .agg(
            *[
                F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"{k}_count")
                for k in ("nodes", "edges", "materials")
            ]
        )
    )


def children_counts(nodes: DataFrame) -> DataFrame:
    """Base children per parent."""
    return (
        nodes.filter(~F.col("is_deleted"))
        .groupBy("site_id", F.col("auto_parent_id").alias("parent_id"))
        .agg(F.count("*").alias("children"))
    )


def click_stats(outcomes: DataFrame) -> DataFrame:
    """Clicks per session by outcome (paired / unpaired / duplicate edge)."""
    return outcomes.groupBy("session_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") == "paired").alias("paired"),
        F.count_if(F.col("outcome") == "unpaired").alias("unpaired"),
        F.count_if((F.col("outcome") == "paired") & F.col("is_duplicate")).alias("skipped_duplicate"),
    )


def crawl_progress(logs: DataFrame, queue: DataFrame, nodes: DataFrame) -> DataFrame:
    """Progress figures per task: logs, queue and nodes each reduced first, then joined."""
    fetched = task_summary(logs)
    queued = queue.groupBy("task_id").agg(
        F.count_if(F.col("state") == "pending").alias("queue_length"),
        F.count_if(F.col("state") == "skipped").alias("skipped"),
        F.min("site_id").alias("site_id"),
    )
    found = nodes.filter(~F.col("is_deleted")).groupBy("site_id").agg(F.count("*").alias("discovered"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        queued.join(fetched, "task_id", "full")
        .join(found, "site_id", "left")
        .select("task_id", *[zero(c) for c in ("fetched", "ok", "failed", "skipped", "discovered", "queue_length")])
    )


def probe_status(probes: DataFrame) -> DataFrame:
    """Verdict of a reachability probe (reachable, is_html, http_status, content_type)."""
    ok = F.coalesce(F.col("http_status") < 400, F.lit(False))
    status = (
        F.when(~F.col("reachable"), "error")
        .when(F.col("is_html"), F.when(ok, "ok").otherwise("error"))
        .when(F.col("content_type").isNull(), "queued")
        .otherwise("error")
    )
    accept = ~F.col("reachable") | F.col("is_html") | F.col("content_type").isNull()
    return probes.withColumn("probe_status", status).withColumn("accept", accept)
