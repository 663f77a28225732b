"""Quality masks: values become null, rows stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILL = -3000


def unfilled(value: Column) -> Column:
    """Null for the fill value and NaN."""
    return F.when((value != FILL) & ~F.isnan(value.cast("double")), value)


def reliable(value: Column, reliability: Column, least: int = 0, most: int = 2) -> Column:
    """Null unless the reliability lies within the bounds, both included."""
    return F.when(reliability.between(least, most), value)


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.abs(value) < float("inf"), value)
