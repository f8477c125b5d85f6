"""The crawl queue as a table: what is due, what to pick, when to fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import QUEUE_STATES
from ..plans.ordered import first_n, running, with_row_number


def queue_due(queue: DataFrame, now: int) -> DataFrame:
    """Pending items whose retry time, if any, has come."""
    return queue.filter(
        (F.col("state") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    )


def frontier_pick(queue: DataFrame, k: int, per_host: int, now: int) -> DataFrame:
    """Next ``k`` due items per task, shallow first, at most ``per_host`` of one host."""
    due = queue_due(queue, now)
    order = ["-priority", "id"]
    return first_n(first_n(due, ["task_id", "host"], order, per_host), ["task_id"], order, k)


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Items of ``new`` (task_id, site_id, node_id, depth) that are not queued yet."""
    fresh = new.groupBy("task_id", "node_id").agg(
        F.min_by("site_id", "depth").alias("site_id"), F.min("depth").alias("depth")
    )
    return (
        fresh.join(queue.select("task_id", "node_id"), ["task_id", "node_id"], "left_anti")
        .withColumn("priority", -F.col("depth"))
        .withColumn("state", F.lit("pending"))
    )


def recover_queue(queue: DataFrame) -> DataFrame:
    """After a restart, running items are pending again."""
    return queue.withColumn("state", F.when(F.col("state") == "running", "pending").otherwise(F.col("state")))


def recover_tasks(tasks: DataFrame) -> DataFrame:
    """After a restart, running tasks are paused."""
    return tasks.withColumn("status", F.when(F.col("status") == "running", "paused").otherwise(F.col("status")))


def apply_retries(queue: DataFrame, plan: DataFrame, now: int) -> DataFrame:
    """Items with a retry plan (id, retry, delay_ms) wait for it with one more attempt."""
    p = plan.select(F.col("id").alias("_id"), "retry", "delay_ms")
    again = F.coalesce(F.col("retry"), F.lit(False))
    replaced = {
        "state": F.when(again, "pending").otherwise(queue["state"]),
        "attempts": F.when(again, queue["attempts"] + 1).otherwise(queue["attempts"]),
        "next_retry_at": F.when(again, F.lit(now) + F.col("delay_ms")).otherwise(queue["next_retry_at"]),
    }
    return queue.join(p, queue["id"] == p["_id"], "left").select(
        *[replaced.get(c, queue[c]).alias(c) for c in queue.columns]
    )


def schedule(
    queue: DataFrame, min_delay_ms: int = 1000, per_host: int = 2, jitter_ms: int = 0, seed: int = 0
) -> DataFrame:
    """Earliest start and slot per host, in queue order.

    Every host's requests are spaced by ``min_delay_ms`` (plus a random part up
    to ``jitter_ms``, drawn from the item's id) and dealt to ``per_host`` slots.
    One host may hold a third of the queue: numbering and running sums are
    split by ``plans.ordered``.
    """
    order = ["-priority", "id"]
    # hashing the id instead of rand() keeps the plan the same on recomputation
    extra = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(jitter_ms, 0) + 1))
    gaps = {"_rn": ("sum", F.lit(1)), "_wait": ("sum", F.col("_extra"))}
    ranked = running(queue.withColumn("_extra", extra), ["host"], order, gaps)
    place = F.col("_rn") - 1
    return ranked.select(
        *queue.columns,
        (place.cast("long") * min_delay_ms + F.when(place > 0, F.col("_wait")).otherwise(0)).alias("start_ms"),
        (place % per_host).cast("int").alias("slot"),
    )


def queue_counts(queue: DataFrame) -> DataFrame:
    """Items per state and task, all states present."""
    return queue.groupBy("task_id").agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in QUEUE_STATES]
    )


def number_manual_edges(edges: DataFrame) -> DataFrame:
    """order_in_page of manual edges = edges the page has before them."""
    ranked = with_row_number(edges, ["site_id", "from_id"], ["id"], "_rn")
    place = F.col("_rn") - 1
    number = F.when(F.col("source") == "manual", place).otherwise(F.col("order_in_page")).cast("int")
    return ranked.withColumn("order_in_page", number).drop("_rn")
