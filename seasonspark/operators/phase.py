"""Phase unwrapping and truncating shifts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_unwrapped(df: DataFrame, phase: str, order: Sequence[str], keys: Sequence[str] = (), name: str = "unwrapped") -> DataFrame:
    """Adds whole turns to a phase so that successive differences fall in (-pi, pi]; each key starts anew."""
    w = Window.partitionBy(*keys).orderBy(*order)
    turns = F.ceil((F.col(phase) - F.lag(phase).over(w) - math.pi) / (2 * math.pi))
    df = df.withColumn("_turns", F.coalesce(turns, F.lit(0)))
    total = F.sum("_turns").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.col(phase) - 2 * math.pi * total).drop("_turns")


def shifted_index(size: Column, lag: Column, rotate: bool = False) -> Column:
    """Zero-based places ``k mod n``, k = 0 ... n - lag - 1: a positive lag drops the tail, a negative one
    appends the head. With ``rotate`` the series is turned instead, lag places to the left."""
    n = size.cast("int")
    if rotate:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.pmod(k + lag, n))).otherwise(F.array().cast("array<int>"))
    empty = F.array().cast("array<int>")
    return F.when((n > 0) & (lag < n), F.transform(F.sequence(F.lit(0), (n - lag - 1).cast("int")), lambda k: F.pmod(k, n))).otherwise(empty)
