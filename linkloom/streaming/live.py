"""Streaming forms of progress, node discovery and visit counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import first_n


def progress_snapshots(
    events: DataFrame, interval: str = "400 milliseconds", delay: str = "10 seconds", key: str = "task_id"
) -> DataFrame:
    """Latest snapshot per task and interval (ts, event_id, figures…); the rest is throttled away."""
    figures = [c for c in events.columns if c not in (key, "ts")]
    return (
        events.withWatermark("ts", delay)
        .groupBy(key, F.window("ts", interval).alias("w"))
        .agg(F.max_by(F.struct(*figures), F.struct("ts", "event_id")).alias("_r"), F.count("*").alias("snapshots"))
        .select(key, F.col("w.start").alias("window_start"), "snapshots", *[F.col(f"_r.{c}").alias(c) for c in figures])
    )


def new_nodes(found: DataFrame, known: DataFrame | None = None, delay: str = "1 hour") -> DataFrame:
    """Each (site_id, identity_key) once, when first seen.

    ``known`` is the node table: what it has is left out, so state only covers
    the time until new nodes are in it (``delay``).
    """
    if known is not None:
        found = found.join(known.select("site_id", "identity_key"), ["site_id", "identity_key"], "left_anti")
    return found.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["site_id", "identity_key"])


def visit_counts(logs: DataFrame, limit: int = 3, period: str = "30 days", delay: str = "1 hour") -> DataFrame:
    """Running visits per identity and crawl period, with a flag over the limit (update mode).

    A period's counts leave the state when the watermark has passed its end.
    """
    return (
        logs.withWatermark("ts", delay)
        .groupBy("site_id", "identity_key", F.window("ts", period).alias("_w"))
        .agg(F.count("*").alias("visits"))
        .select("site_id", "identity_key", F.col("_w.start").alias("period_start"), "visits", (F.col("visits") > limit).alias("over_limit"))
    )


def event_tail(events: DataFrame, n: int = 400, order: tuple[str, ...] = ("-ts", "-event_id")) -> DataFrame:
    """Last ``n`` events per session."""
    return first_n(events, ["session_id"], order, n)
