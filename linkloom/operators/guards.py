"""Crawl guards as set operations in a fixed page order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import first_segment, path_prefixes
from ..plans.ordered import first_n, sort_columns


def flag_duplicates(pages: DataFrame) -> DataFrame:
    """Mark later pages with a fingerprint already seen in their site.

    Input: site_id, fingerprint, fetch_seq.  Only repeated fingerprints are
    joined back; the page side of a hot fingerprint is split by AQE.
    """
    firsts = (
        pages.filter(F.col("fingerprint").isNotNull())
        .groupBy(F.col("site_id").alias("_s"), F.col("fingerprint").alias("_f"))
        .agg(F.min("fetch_seq").alias("_first"), F.count("*").alias("_n"))
        .filter(F.col("_n") > 1)
    )
    on = (F.col("site_id") == F.col("_s")) & (F.col("fingerprint") == F.col("_f"))
    known = pages.filter(F.col("fingerprint").isNotNull())
    flagged = known.join(firsts, on, "left").select(
        *[known[c] for c in pages.columns],
        F.coalesce(F.col("fetch_seq") > F.col("_first"), F.lit(False)).alias("is_duplicate"),
    )
    # pages without a fingerprint take no part in the join, where they would all meet
    others = pages.filter(F.col("fingerprint").isNull())
    return flagged.unionByName(others.withColumn("is_duplicate", F.lit(False)))


def _nth(df: DataFrame, keys: list[str], order: str, n: int, name: str) -> DataFrame:
    """Order value of the n-th row of each group that has one."""
    return (
        first_n(df.select(*keys, order), keys, [order], n)
        .groupBy(*keys)
        .agg(F.max(order).alias(name), F.count("*").alias("_n"))
        .filter(F.col("_n") >= n)
        .drop("_n")
    )


def flag_visits(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """Mark attempts beyond the visit limit.  Input: site_id, identity_key, seq (unique)."""
    cut = _nth(attempts, ["site_id", "identity_key"], "seq", limit + 1, "_cut")
    return attempts.join(cut, ["site_id", "identity_key"], "left").select(
        *[attempts[c] for c in attempts.columns],
        F.coalesce(F.col("seq") >= F.col("_cut"), F.lit(False)).alias("over_limit"),
    )


def limit_pagination(
    links: DataFrame, limit: int = 50, carried: DataFrame | None = None, order: tuple[str, ...] = ("link_seq",)
) -> DataFrame:
    """Drop paged links once their series has used its budget.

    Input: site_id, series_key (NULL = not paged) and a total ``order``.  Every
    occurrence spends budget, repeated links included.  ``carried``:
    (site_id, series_key, used) from earlier rounds.
    """
    keys = ["site_id", "series_key"]
    free = links.filter(F.col("series_key").isNull())
    best = first_n(links.filter(F.col("series_key").isNotNull()), keys, order, limit)
    if carried is None:
        return free.unionByName(best)
    # at most `limit` rows per series are left, so this window is bounded
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    passed = (
        best.withColumn("_rn", F.row_number().over(w))
        .join(carried, keys, "left")
        .filter(F.col("_rn") + F.coalesce("used", F.lit(0)) <= limit)
    )
    return free.unionByName(passed.select(*links.columns))


def prefix_hits(pages: DataFrame, threshold: int = 20) -> DataFrame:
    """Hits per path prefix over ok pages (site_id, pathname); which ones cross the threshold."""
    return (
        pages.select("site_id", F.explode(path_prefixes(F.col("pathname"))).alias("prefix"))
        .groupBy("site_id", "prefix")
        .agg(F.count("*").alias("hits"))
        .withColumn("pruned", F.col("hits") > threshold)
    )


def prefix_crossings(hits: DataFrame, threshold: int) -> DataFrame:
    """When each first segment is pruned: ``crossed_at`` = seq of hit number threshold+1.

    A deeper prefix never has more hits than its first segment, so the first
    segment alone decides.  Input: site_id, pathname, seq of ok pages.
    """
    seg = hits.withColumn("prefix", first_segment(F.col("pathname"))).filter(F.col("prefix").isNotNull())
    return _nth(seg, ["site_id", "prefix"], "seq", threshold + 1, "crossed_at")


def prune_prefixes(links: DataFrame, hits: DataFrame, threshold: int = 20) -> DataFrame:
    """Add ``pruned_by``: the prefix pruned before the link's page was handled.

    Links: site_id, pathname, from_seq.
    """
    crossed = prefix_crossings(hits, threshold)
    keyed = links.withColumn("prefix", first_segment(F.col("pathname")))
    pruned = F.when(F.col("crossed_at") < F.col("from_seq"), F.col("prefix"))
    return keyed.join(crossed, ["site_id", "prefix"], "left").select(
        *[keyed[c] for c in links.columns], pruned.alias("pruned_by")
    )


def is_retryable(http_status: Column) -> Column:
    return http_status.isNull() | http_status.isin(408, 425, 429) | (http_status >= 500)


def retry_plan(
    attempts: DataFrame, max_retries: int = 2, base_ms: int = 1000, cap_ms: int = 30_000, jitter: float | None = None
) -> DataFrame:
    """Add ``retry`` and ``delay_ms`` from attempt and http_status.

    Doubling backoff with a cap; ``jitter`` (0.1 = ±10 %) is off by default so
    that results repeat.
    """
    delay = F.least(
        F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.greatest(F.col("attempt") - 1, F.lit(0))),
        F.lit(float(max(base_ms, cap_ms))),
    )
    if jitter:
        delay = F.greatest(F.lit(0.0), delay * (1 + F.lit(jitter) * (F.rand() * 2 - 1)))
    retry = is_retryable(F.col("http_status")) & (F.col("attempt") <= max_retries)
    return attempts.withColumn("retry", retry).withColumn(
        "delay_ms", F.when(retry, F.round(delay).cast("long")).otherwise(F.lit(0).cast("long"))
    )
