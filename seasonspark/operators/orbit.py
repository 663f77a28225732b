"""Orbital tables: spline interpolation, dense lookup, insolation series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonspark.functions.insolation import daily_insolation
from seasonspark.functions.waveforms import Value, col
from seasonspark.operators.phase import shifted_index, with_unwrapped

#: Steps per kyr of the dense table and its last kyr.
DENSE_STEPS, DENSE_END = 10, 5000
#: Knots that the driver may solve, those that may lie at uneven distances, and rows of a lookup table that may be broadcast.
MAX_KNOTS, MAX_UNEVEN, BROADCAST_ROWS = 100_000, 10_000, 1_000_000


def prepared(orbit: DataFrame) -> DataFrame:
    """``(kyear, ecc, omega, epsilon)`` from the raw table: time counted backwards, omega turned by 180 degrees
    and unwrapped (radians) in table order, epsilon in degrees."""
    turned = orbit.select((-F.col("kyear")).alias("kyear"), "ecc", F.radians(F.col("omega_deg") + 180).alias("phase"), F.col("epsilon_deg").alias("epsilon"))
    return with_unwrapped(turned, "phase", ["kyear"], name="omega").select("kyear", "ecc", "omega", "epsilon")


def not_a_knot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (interval, column; constant to cubic, relative to the left knot) of the cubic splines through the columns of ``y``."""
    n = len(x)
    if n < 4:
        raise ValueError("a cubic spline takes four knots")
    h, slope = np.diff(x), np.diff(y, axis=0) / np.diff(x)[:, None]
    # Second derivatives m: smooth inside; third derivative continuous at the second and last but one knot.
    inner = np.zeros((3, n))
    inner[0, 2:], inner[1, 1:-1], inner[2, :-2] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    right = np.zeros(y.shape)
    right[1:-1] = 6 * np.diff(slope, axis=0)
    # m0 and m(n-1) are linear in their neighbours and are put into the first and last inner rows.
    a0, b0 = 1 + h[0] / h[1], -h[0] / h[1]
    a1, b1 = 1 + h[-1] / h[-2], -h[-1] / h[-2]
    low, mid, up = inner[2, :-2].copy(), inner[1, 1:-1].copy(), inner[0, 2:].copy()
    rhs = right[1:-1].copy()
    mid[0] += low[0] * a0
    up[0] += low[0] * b0
    mid[-1] += up[-1] * a1
    low[-1] += up[-1] * b1
    k = n - 2
    for i in range(1, k):
        f = low[i] / mid[i - 1]
        mid[i] -= f * up[i - 1]
        rhs[i] -= f * rhs[i - 1]
    m = np.zeros(y.shape)
    m[k] = rhs[-1] / mid[-1]
    for i in range(k - 2, -1, -1):
        m[i + 1] = (rhs[i] - up[i] * m[i + 2]) / mid[i]
    m[0], m[-1] = a0 * m[1] + b0 * m[2], a1 * m[-2] + b1 * m[-3]
    h = h[:, None]
    return np.stack([y[:-1], slope - h * (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, np.diff(m, axis=0) / (6 * h)], 2)


def spline_table(table: DataFrame, x: str, columns: Sequence[str]) -> tuple[DataFrame, np.ndarray]:
    """Coefficients per interval of a knot table of checked size, and the knots."""
    rows = table.select(x, *columns).orderBy(x).limit(MAX_KNOTS + 1).toArrow()
    if len(rows) > MAX_KNOTS:
        raise ValueError(f"more than {MAX_KNOTS} knots")
    data = np.stack([rows.column(i).to_numpy().astype(float) for i in range(1 + len(columns))], 1)
    knots, parts = data[:, 0], not_a_knot(data[:, 0], data[:, 1:])
    made = {"interval": pa.array(np.arange(len(knots) - 1, dtype=np.int32)), "knot": pa.array(knots[:-1])}
    made |= {f"{c}_{k}": pa.array(np.ascontiguousarray(parts[:, i, k])) for i, c in enumerate(columns) for k in range(4)}
    return table.sparkSession.createDataFrame(pa.table(made)), knots


def evaluate(df: DataFrame, at: str, table: DataFrame, x: str, columns: Sequence[str]) -> DataFrame:
    """Spline values of ``columns`` at column ``at``; the end pieces go on outside. Table values at the knots."""
    coefficients, knots = spline_table(table, x, columns)
    step = np.diff(knots)
    if len(step) and np.allclose(step, step[0], rtol=1e-12, atol=0):
        place = F.least(F.greatest(F.floor((col(F.col(at)) - float(knots[0])) / float(step[0])).cast("int"), F.lit(0)), F.lit(len(knots) - 2))
    elif len(knots) > MAX_UNEVEN:
        raise ValueError(f"more than {MAX_UNEVEN} knots at uneven distances")
    else:
        place = F.size(F.filter(F.array(*map(F.lit, knots[1:-1].tolist())), lambda k: k <= F.col(at)))
    joined = df.withColumn("interval", place).join(F.broadcast(coefficients), "interval")
    d = F.col(at) - F.col("knot")

    def horner(c: str) -> Column:
        a, b, q, k = (F.col(f"{c}_{i}") for i in range(4))
        return a + d * (b + d * (q + d * k))

    return joined.withColumns({c: horner(c) for c in columns}).drop("interval", *coefficients.columns)


def dense(spark: SparkSession, table: DataFrame, end: int = DENSE_END) -> DataFrame:
    """``(idx, kyear, ecc, eps_rad, omega_rad)`` in steps of a tenth of a kyr, a fixed number of rows."""
    domain = spark.range(end * DENSE_STEPS + 1).select(F.col("id").cast("int").alias("idx"), (F.col("id") / DENSE_STEPS).alias("kyear"))
    return evaluate(domain, "kyear", table, "kyear", ["ecc", "omega", "epsilon"]).select("idx", "kyear", "ecc", F.radians("epsilon").alias("eps_rad"), F.col("omega").alias("omega_rad"))


def lookup(df: DataFrame, kyear: str, dense_table: DataFrame) -> DataFrame:
    """Adds the elements of the nearest dense row, halves to even; null outside the table. Tables of up to
    ``BROADCAST_ROWS`` rows are broadcast."""
    idx, table = F.bround(F.col(kyear) * DENSE_STEPS).cast("int"), dense_table.drop("kyear")
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.withColumn("idx", idx).join(F.broadcast(table) if small else table, "idx", "left").drop("idx")


def insolation(df: DataFrame, lat: Value, day: Column | str = "day", day_type: int = 1) -> DataFrame:
    """Adds ``fsw`` and ``lambda`` to rows with ``ecc, eps_rad, omega_rad`` and a day."""
    found = daily_insolation(lat, F.col(day) if isinstance(day, str) else day, F.col("ecc"), F.col("eps_rad"), F.col("omega_rad"), day_type)
    return df.withColumn("fsw", found.fsw).withColumn("lambda", found.longitude)


def over_days(df: DataFrame, last: int = 365) -> DataFrame:
    return df.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(last))))


def annual_mean(df: DataFrame, lat: Value, key: str = "kyear") -> DataFrame:
    return insolation(over_days(df), lat).groupBy(key).agg(F.avg("fsw").alias("fsw"))


def december_calendar(df: DataFrame, lat: Value, key: str = "kyear", rotate: bool = False) -> DataFrame:
    """``(key, place, fsw)``: the year's curve shifted so that the solstice (longitude nearest 270) meets day 355."""
    year = insolation(over_days(df), lat)
    curve = year.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("day", "fsw"))).alias("c"), F.min_by("day", F.struct(F.abs(F.col("lambda") - 270), "day")).alias("solstice"))
    shift = 355 - (F.col("solstice") - 1)
    places = curve.withColumn("index", shifted_index(F.size("c"), shift, rotate))
    return places.select(key, "c", F.posexplode("index").alias("place", "at")).select(key, "place", F.element_at("c", F.col("at") + 1).fsw.alias("fsw"))


def clipped(flux: Column, ceiling: float = 510.0) -> Column:
    return F.least(flux, F.lit(ceiling))
