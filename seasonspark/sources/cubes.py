"""Parameter cubes: NPZ files and Parquet tables of the same rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import IO
from zipfile import ZIP_DEFLATED, ZipFile

import numpy as np
import pyarrow as pa
from numpy.lib.format import read_array_header_1_0, read_array_header_2_0, read_magic, write_array_header_1_0
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seasonspark.sources.schemas import FIT_PARAMS, GAUSSIAN_PARAMS, assert_schema

#: Channels of the last axis, and the keys under which a raw or a cleaned cube is kept. Fixed values.
CHANNELS = tuple(FIT_PARAMS.names[2:])
KEYS = ("ndvi_fit_all", "ndvi_fit_params")
ROWS_PER_PART = 64


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _NpzReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    @contextmanager
    def _open(self) -> Iterator[tuple[IO[bytes], tuple[int, ...], np.dtype]]:
        """The stream of the cube's values behind its header, its shape and type; nothing is loaded."""
        with ZipFile(self.path) as files:
            key = next((k for k in KEYS if f"{k}.npy" in files.namelist()), None)
            if key is None:
                raise ValueError(f"{self.path} has none of {KEYS}")
            with files.open(f"{key}.npy") as stream:
                header = read_array_header_1_0 if read_magic(stream) == (1, 0) else read_array_header_2_0
                shape, fortran, kind = header(stream)
                if len(shape) != 3 or shape[2] < 6 or fortran:
                    raise ValueError(f"{self.path}: a cube of rows, columns and at least six channels in C order is needed")
                yield stream, shape, kind

    def partitions(self) -> Sequence[InputPartition]:
        with self._open() as (_, shape, _kind):
            return [_Rows(i, min(i + ROWS_PER_PART, shape[0])) for i in range(0, shape[0], ROWS_PER_PART)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        with self._open() as (stream, shape, kind):
            row = shape[1] * shape[2] * kind.itemsize
            stream.seek(stream.tell() + partition.first * row)
            rows = partition.last - partition.first
            cube = np.frombuffer(stream.read(rows * row), kind).reshape(rows, *shape[1:]).astype(float)
        rows, cols, channels = cube.shape
        flat = cube.reshape(rows * cols, channels)
        at = [pa.array(np.repeat(np.arange(partition.first, partition.last, dtype=np.int32), cols)), pa.array(np.tile(np.arange(cols, dtype=np.int32), rows))]
        values = [pa.array(flat[:, i], from_pandas=True) if i < channels else pa.nulls(rows * cols, pa.float64()) for i in range(len(CHANNELS))]
        yield pa.RecordBatch.from_arrays(at + values, names=["row", "col", *CHANNELS])


class NpzCube(DataSource):
    """``spark.read.format("npz_cube").load(path)``: ``fit_params`` rows, NaN as null, raw and cleaned cubes alike."""

    @classmethod
    def name(cls) -> str:
        return "npz_cube"

    def schema(self) -> str:
        return "row int, col int, " + ", ".join(f"{c} double" for c in CHANNELS)

    def reader(self, schema) -> DataSourceReader:
        return _NpzReader(self.options["path"])


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(NpzCube)
    return spark.read.format("npz_cube").load(path)


def write_npz(params: DataFrame, path: str, key: str = KEYS[0], band_cells: int = 1_000_000) -> None:
    """Export for array tools: a float32 cube of the whole grid, NaN where there is no row.

    The driver writes bands of about ``band_cells`` cells one after the other and holds one at a time.
    """
    params = assert_schema(params, FIT_PARAMS)
    last = params.agg(F.max("row").alias("row"), F.max("col").alias("col")).first()
    rows, cols = (0, 0) if last.row is None else (last.row + 1, last.col + 1)
    band = max(1, band_cells // max(1, cols))
    with ZipFile(path, "w", ZIP_DEFLATED) as files, files.open(f"{key}.npy", "w", force_zip64=True) as stream:
        write_array_header_1_0(stream, {"descr": "<f4", "fortran_order": False, "shape": (rows, cols, len(CHANNELS))})
        for first in range(0, rows, band):
            part = params.where(F.col("row").between(first, first + band - 1)).toPandas()
            cube = np.full((min(band, rows - first), cols, len(CHANNELS)), np.nan, "<f4")
            cube[part.row - first, part.col] = part[list(CHANNELS)].to_numpy(float)
            stream.write(cube.tobytes())


def write_params(params: DataFrame, path: str) -> None:
    """Fit parameters (raw or cleaned) as Parquet in cell order."""
    assert_schema(params, FIT_PARAMS).repartitionByRange("row", "col").sortWithinPartitions("row", "col").write.mode("overwrite").parquet(path)


def write_gaussian(params: DataFrame, path: str, metadata: dict[str, str | int | float] | None = None) -> None:
    """Gaussian parameters as Parquet in cell order. ``metadata`` goes with each map, as the metadata of its column."""
    maps = assert_schema(params, GAUSSIAN_PARAMS)
    maps = maps.select("row", "col", *(F.col(c).alias(c, metadata=metadata or {}) for c in GAUSSIAN_PARAMS.names[2:]))
    maps.repartitionByRange("row", "col").sortWithinPartitions("row", "col").write.mode("overwrite").parquet(path)
