"""Scenes: discovery by file name, layer readers, the observation stack."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seasonspark.functions.names import date_of, scene_part
from seasonspark.operators.quality import reliable, unfilled

PATTERN = "MOD13C1.A*.hdf"
#: Names of the two layers of a granule. Fixed values.
LAYERS = {"ndvi": "CMG 0.05 Deg 16 days NDVI", "reliability": "CMG 0.05 Deg 16 days pixel reliability"}


def discover(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """``scene`` rows of the matching files by name, which is time order; file contents are not read.

    Names without a date are left out. No file at all is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path")
    scenes = describe(files, "path")
    if scenes.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return scenes


def describe(files: DataFrame, path: str = "file") -> DataFrame:
    """Scene rows of file names."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    out = files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("scene_id"), F.col(path).alias("file"), scene_part(name, 1).alias("year"), scene_part(name, 2).alias("doy"))
    return out.withColumn("acq_date", date_of(F.col("year"), F.col("doy"))).where("acq_date is not null").orderBy("scene_id")


def masked(layers: DataFrame) -> DataFrame:
    """Fill values and unreliable cells of ``scene_layer`` rows become null."""
    return layers.withColumn("ndvi", reliable(unfilled(F.col("ndvi")), F.col("reliability")))


def observations(layers: DataFrame, scenes: DataFrame) -> DataFrame:
    """The long stack: masked cells with the time of their scene. The scene table is joined by key, not by position."""
    return masked(layers).join(scenes.select("scene_id", "year", "doy"), "scene_id").select("row", "col", "year", "doy", "ndvi")


def catalog(df: DataFrame) -> DataFrame:
    """``(name, type, nullable, metadata)`` of a relation's columns, metadata as JSON."""
    fields = [(f.name, f.dataType.simpleString(), f.nullable, json.dumps(f.metadata, sort_keys=True)) for f in df.schema]
    return df.sparkSession.createDataFrame(fields, "name string, type string, nullable boolean, metadata string")


def write_stack(stack: DataFrame, path: str, tile: int = 16) -> None:
    """Parquet by year, cells of a tile side by side, so that year, row and column filters prune."""
    tiled = stack.repartition("year", F.floor(F.col("row") / tile), F.floor(F.col("col") / tile))
    tiled.sortWithinPartitions("year", "row", "col", "doy").write.mode("overwrite").partitionBy("year").parquet(path)


def read_stack(spark: SparkSession, path: str, year: int | None = None, doy: int | None = None) -> DataFrame:
    """The stack, or one time slice of it."""
    df = spark.read.parquet(path)
    for column, value in (("year", year), ("doy", doy)):
        df = df if value is None else df.where(F.col(column) == value)
    return df.select("row", "col", "year", "doy", "ndvi")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _GridReader(DataSourceReader):
    """One partition per file."""

    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self) -> Sequence[InputPartition]:
        return [_File(p) for p in self.paths]


def read_granule(path: str) -> dict[str, np.ndarray]:
    """The two layers of an HDF4 granule."""
    try:
        from pyhdf.SD import SD, SDC
    except ImportError as e:
        raise ImportError("HDF4 granules take the package pyhdf") from e
    granule = SD(path, SDC.READ)
    try:
        return {k: granule.select(name)[:] for k, name in LAYERS.items()}
    finally:
        granule.end()


def readable(path: str, strict: bool, read=read_granule) -> dict[str, np.ndarray] | None:
    """A granule's layers; of one that cannot be read or whose layers differ in shape, an error if ``strict``, else a warning and None."""
    try:
        layers = read(path)
        if len({layer.shape for layer in layers.values()}) != 1 or layers["ndvi"].ndim != 2:
            raise ValueError(f"{path}: the layers are not of one shape")
        return layers
    except ImportError:
        raise
    except Exception as e:
        if strict:
            raise
        warnings.warn(f"{path} is left out: {e}", stacklevel=2)
        return None


class _HdfReader(_GridReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.strict = options.get("strict", "false").lower() == "true"

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        layers = readable(partition.path, self.strict)
        if layers is None:
            return
        scene = partition.path.rpartition("/")[2].rpartition(".")[0]
        rows, cols = layers["ndvi"].shape
        for r in range(rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array([scene] * cols), pa.array(np.full(cols, r, np.int32)), pa.array(np.arange(cols, dtype=np.int32)), pa.array(layers["ndvi"][r].astype(float)), pa.array(layers["reliability"][r].astype(np.int32))],
                names=["scene_id", "row", "col", "ndvi", "reliability"],
            )


class Hdf4Scenes(DataSource):
    """``spark.read.format("hdf4_scenes").option("paths", "a.hdf,b.hdf")``: ``scene_layer`` rows. Unreadable granules
    are left out with a warning, or fail the job with ``option("strict", "true")``."""

    @classmethod
    def name(cls) -> str:
        return "hdf4_scenes"

    def schema(self) -> str:
        return "scene_id string, row int, col int, ndvi double, reliability int"

    def reader(self, schema) -> DataSourceReader:
        return _HdfReader(self.options)
