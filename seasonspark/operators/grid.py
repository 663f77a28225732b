"""The regular 0.05 degree grid, row 0 at 90 N and column 0 at 180 W."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonspark.functions.waveforms import Value, col

CELL, ROWS, COLS = 0.05, 3600, 7200
#: Half-open row and column ranges of the European window. Fixed values.
EUROPE = (320, 1198, 3335, 4553)


def row_of(lat: Value) -> Column:
    """Row of a latitude, truncated towards zero; null outside the grid."""
    row = ((90 - col(lat)) / CELL).cast("int")
    return F.when((row >= 0) & (row < ROWS), row)


def col_of(lon: Value) -> Column:
    column = ((col(lon) + 180) / CELL).cast("int")
    return F.when((column >= 0) & (column < COLS), column)


def crop(df: DataFrame, row_from: int, row_to: int, col_from: int, col_to: int, rebase: bool = True) -> DataFrame:
    """Cells of half-open ranges, numbered from 0. The ranges reach the scan as pushed filters."""
    inside = df.where((F.col("row") >= row_from) & (F.col("row") < row_to) & (F.col("col") >= col_from) & (F.col("col") < col_to))
    return inside.withColumns({"row": F.col("row") - row_from, "col": F.col("col") - col_from}) if rebase else inside


def shape(df: DataFrame) -> DataFrame:
    """``(rows, cols)`` of a grid."""
    return df.agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


def pixel(df: DataFrame, lat: float, lon: float) -> DataFrame:
    """The series of one location, in time order."""
    return df.where((F.col("row") == row_of(lat)) & (F.col("col") == col_of(lon))).orderBy("year", "doy")
