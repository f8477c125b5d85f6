"""Ordering within groups that survives a group holding a third of all rows.

A plain window sorts each group in one task.  Here rows are range-partitioned by
group and order together, so a large group lies in many partitions, and are
written with the number of their partition.  Values run within a partition and
are completed by the totals of the group's earlier partitions, of which there is
one short row per group and partition.  One plan serves groups of all sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import by_merge, staged

# Spark pushes row_number() <= n below the shuffle only up to this n
# (spark.sql.optimizer.windowGroupLimitThreshold, default 1000).
PUSHED_LIMIT = 1000
SALTS = 256


def _desc_flags(order: Sequence[str]) -> list[tuple[str, bool]]:
    """``"-name"`` means descending."""
    return [(o[1:], True) if o.startswith("-") else (o, False) for o in order]


def sort_columns(order: Sequence[str]) -> list[Column]:
    """Ascending = nulls last, descending = nulls last; never engine-dependent."""
    return [
        F.col(name).desc_nulls_last() if desc else F.col(name).asc_nulls_last()
        for name, desc in _desc_flags(order)
    ]


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of every group.

    For small ``n`` Spark limits each group before the shuffle.  For larger
    ``n`` the same is done here by a salted first pass.
    """
    ordering = sort_columns(order)
    if n > PUSHED_LIMIT:
        salt = F.pmod(F.xxhash64(*[F.col(name) for name, _ in _desc_flags(order)]), F.lit(SALTS))
        w1 = Window.partitionBy(*[F.col(k) for k in keys], F.col("_salt")).orderBy(*ordering)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_rn", F.row_number().over(w1))
            .filter(F.col("_rn") <= n)
            .drop("_rn", "_salt")
        )
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*ordering)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` in ranges of group and order, written with their number (``_part``), so that totals and rows are sure to speak of the same ranges.

    Given such a frame, or columns added to it, the functions below deal no more; their
    groups and order must agree with its ranges.
    """
    if "_part" in df.columns:
        return df
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *sort_columns(order))
    return staged(ranged.withColumn("_part", F.spark_partition_id()), "ranged")


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: dict[str, tuple[str, Column]],
    *,
    exclusive: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Running sum / max / min within each group in the given total order.

    ``exclusive`` leaves the current row out; the first row of a group then has
    NULL.  ``max`` and ``min`` over structs are compared with ``greatest`` and
    ``least``.  ``partitions`` defaults to the session's shuffle partitions.
    """
    ordering = sort_columns(order)
    ranged = dealt(df, keys, order, partitions)
    totals = ranged.groupBy(*keys, "_part").agg(*[_COMBINE[k][0](c).alias(f"_t_{a}") for a, (k, c) in aggs.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", *[_COMBINE[k][0](f"_t_{a}").over(before).alias(f"_o_{a}") for a, (k, _) in aggs.items()])
    w = Window.partitionBy(*keys, "_part").orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    local = ranged.select("*", *[_COMBINE[k][0](c).over(w).alias(f"_l_{a}") for a, (k, c) in aggs.items()])
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_part"]])
    joined = local.alias("l").join(by_merge(offsets.alias("r")), on, "left")
    result = [_COMBINE[k][1](F.col(f"l._l_{a}"), F.col(f"r._o_{a}")).alias(a) for a, (k, _) in aggs.items()]
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *result)


def with_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", *, partitions: int | None = None) -> DataFrame:
    """``row_number`` (from 1) for all rows of every group."""
    return running(df, keys, order, {name: ("sum", F.lit(1))}, partitions=partitions)


def running_walk(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Column, *, total: str = "total", lowest: str = "lowest") -> DataFrame:
    """``total``: running sum of ``step``; ``lowest``: the least of 0 and the sums of all earlier rows.

    A walk that may not fall below zero stands at ``total - least(lowest, total)``.
    A part of a group is summed up by its sum and its least running sum.
    """
    ordering = sort_columns(order)
    ranged = dealt(df.withColumn("_step", step), keys, order)
    w = Window.partitionBy(*keys, "_part").orderBy(*ordering)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_sum", F.sum("_step").over(upto)).withColumn("_low", F.min("_sum").over(earlier))
    totals = local.groupBy(*keys, "_part").agg(F.sum("_step").alias("_all"), F.min("_sum").alias("_least"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    based = totals.withColumn("_base", F.coalesce(F.sum("_all").over(before), zero))
    offsets = based.withColumn("_floor", F.least(zero, F.min(F.col("_base") + F.col("_least")).over(before))).select(*keys, "_part", "_base", "_floor")
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_part"]])
    joined = local.alias("l").join(offsets.alias("r"), on)
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns], (F.col("r._base") + F.col("l._sum")).alias(total),
        F.least(F.col("r._floor"), F.col("r._base") + F.col("l._low")).alias(lowest),
    )
