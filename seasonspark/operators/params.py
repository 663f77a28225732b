"""Range constraints and summaries of fit parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Inclusive bounds of the double-logistic parameters. Fixed values.
BOUNDS = {"xmid_s": (0.0, 365.0), "scal_s": (1.0, 100.0), "xmid_a": (0.0, 365.0), "scal_a": (1.0, 100.0), "bias": (0.0, 10000.0), "scale": (0.0, 10000.0)}


def constrained(df: DataFrame, bounds: Mapping[str, tuple[float, float]] = BOUNDS) -> DataFrame:
    """Values outside their bounds become null one by one; rows and other columns stay."""
    return df.withColumns({c: F.when(F.col(c).between(low, high), F.col(c)) for c, (low, high) in bounds.items()})


def kept_counts(before: DataFrame, after_bounds: Mapping[str, tuple[float, float]] = BOUNDS) -> DataFrame:
    """``(param, before, after)``: values present before and after the constraint, in one pass."""
    pairs = [F.struct(F.lit(c).alias("param"), F.count(c).alias("before"), F.count(F.when(F.col(c).between(*b), 1)).alias("after")) for c, b in after_bounds.items()]
    return before.agg(F.array(*pairs).alias("x")).select(F.inline("x"))


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(param, min, max, mean, median, std)`` over present values; population deviation."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "param", "value")
    return long.groupBy("param").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("std"))
