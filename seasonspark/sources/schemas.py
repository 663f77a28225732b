"""Schemas of the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "date": T.DateType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


SCENE = _struct("scene_id string, file string, year int, doy int, acq_date date")
SCENE_LAYER = _struct("scene_id string, row int, col int, ndvi double, reliability int")
OBSERVATION = _struct("row int, col int, year int, doy int, ndvi double")
FIT_PARAMS = _struct("row int, col int, xmid_s double, scal_s double, xmid_a double, scal_a double, bias double, scale double, r2 double, cov_quality double")
GAUSSIAN_PARAMS = _struct("row int, col int, a double, mu double, sigma double, c double, r2 double")
ORBIT = _struct("kyear double, ecc double, omega_deg double, epsilon_deg double")
MANIFEST = _struct("url string, filename string")


def assert_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the schema's columns in order; an error names what is missing or of another type."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("missing or of another type: " + ", ".join(wrong))
    return df.select(*schema.names)
