"""Keep costly expressions from being repeated by the optimizer.

Filters are pushed through projections by substituting the projected
expressions, which repeats them once per reference.  For chains of string work
that multiplies the cost, so costly results are passed through a one-element
``explode``: filters on them stay above it and read the finished value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, *names: str) -> DataFrame:
    """Same rows and columns; ``names`` are evaluated exactly once."""
    packed = F.explode(F.array(F.struct(*[F.col(n) for n in names]))).alias("_pin")
    df = df.select(*[c for c in df.columns if c not in names], packed)
    return df.select(*[c for c in df.columns if c != "_pin"], *[F.col(f"_pin.{n}").alias(n) for n in names])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)
