"""Structured Streaming: landed files are read once, late and repeated cells are handled by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = "scene_id string, row int, col int, ndvi double, reliability int, acquired timestamp"


def layers(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Scene layers as their Parquet files land; the checkpoint remembers which were seen."""
    return spark.readStream.schema(LAYERS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def distinct_cells(stream: DataFrame, delay: str = "32 days") -> DataFrame:
    return stream.withWatermark("acquired", delay).dropDuplicatesWithinWatermark(["scene_id", "row", "col"])


def composites(stream: DataFrame, length: str = "16 days", delay: str = "32 days") -> DataFrame:
    """Valid cells, count and mean per grid row and window of acquisition time; repeated cells count once."""
    valid = F.when(F.col("reliability").between(0, 2) & (F.col("ndvi") != -3000), F.col("ndvi"))
    return (
        distinct_cells(stream, delay).groupBy(F.window("acquired", length), "row")
        .agg(F.count("*").alias("cells"), F.count(valid).alias("valid"), F.avg(valid).alias("ndvi"))
    )
