"""Predictions of a parameter grid for days of the year."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonspark.functions.waveforms import double_logistic, greenup_rate

DOY_STEP = 16


def days(spark: SparkSession, start: int = 1, end: int = 365, step: int = DOY_STEP) -> DataFrame:
    """``doy`` from start to end: 23 rows by default."""
    return spark.range(start, end + 1, step).select(F.col("id").cast("int").alias("doy"))


def ndvi(p: Callable[[str], Column], doy: Column) -> Column:
    return double_logistic(doy, *(p(c) for c in ("xmid_s", "scal_s", "xmid_a", "scal_a", "bias", "scale")))


def irg(p: Callable[[str], Column], doy: Column) -> Column:
    return greenup_rate(doy, p("xmid_s"), p("scal_s"))


def frames(params: DataFrame, doys: Sequence[int], model: Callable[[Callable[[str], Column], Column], Column] = ndvi) -> DataFrame:
    """``(doy, row, col, value)``: every cell on every day of a fixed list, exploded within the scan's stage."""
    day = F.explode(F.array(*map(F.lit, doys)))
    return params.withColumn("doy", day).select("doy", "row", "col", model(F.col, F.col("doy")).alias("value"))


def frame_summary(framed: DataFrame) -> DataFrame:
    """Least and greatest value per day and, with null day, overall."""
    return framed.rollup("doy").agg(F.min("value").alias("low"), F.max("value").alias("high"))
