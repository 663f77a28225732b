"""Aggregates over series and grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def r2_pearson(observed: Column, predicted: Column, least: int = 5) -> Column:
    """Squared correlation; null below ``least`` pairs."""
    both = observed.isNotNull() & predicted.isNotNull()
    return F.when(F.count_if(both) >= least, F.regr_r2(predicted, observed))


def r2_sse(observed: Column, predicted: Column) -> Column:
    """One minus residual over total squares; null if the total is 0, negative for fits worse than the mean."""
    both = observed.isNotNull() & predicted.isNotNull()
    residual = F.sum(F.when(both, F.pow(observed - predicted, F.lit(2.0))))
    used = F.when(both, observed)
    total = F.var_pop(used) * F.count(used)
    return 1 - F.try_divide(residual, F.when(total != 0, total))


def first_peak(value: Column, at: Column, seq: Column) -> Column:
    """Where the value is greatest; the first in sequence on ties."""
    return F.min_by(at, F.struct(-value, seq))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of each column per grid row; nulls do not count."""
    return df.groupBy("row").agg(*(F.avg(c).alias(c) for c in columns))
