"""The star schema read as seasonal series, scenes, grids and parameters, in Spark and in SQL.

Values are made missing by the quality mask, since the tables have none. SQL fragments are written so
that both engines compute the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, seq, year, doy, ndvi)``: orders of ``SERIES`` customers' classes, every seventh value missing."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_custkey") % SERIES).alias("key"), F.struct("o_orderdate", "o_orderkey").alias("seq"), F.year("o_orderdate").alias("year"),
        F.dayofyear("o_orderdate").alias("doy"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("ndvi"), F.col("o_orderkey").alias("id"),
    )


SERIES_SQL = f"""series AS (
  SELECT o_custkey % {SERIES} AS key, o_orderdate AS ts, o_orderkey AS id, year(o_orderdate)::INT AS year, dayofyear(o_orderdate)::INT AS doy,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS ndvi FROM orders)"""

#: Series cleaned as in the flagship: baseline, fill, clip, median of three, scaling.
CLEAN_SQL = f"""{SERIES_SQL},
based AS (SELECT *, quantile_cont(ndvi, 0.025) OVER (PARTITION BY key) AS base FROM series),
cleaned AS (SELECT *, CASE WHEN coalesce(ndvi, base) < base THEN base ELSE coalesce(ndvi, base) END AS corrected FROM based),
near AS (SELECT *, coalesce(lag(corrected) OVER w, corrected) AS a, coalesce(lead(corrected) OVER w, corrected) AS b FROM cleaned WINDOW w AS (PARTITION BY key ORDER BY ts, id)),
filtered AS (SELECT *, greatest(least(a, b), least(greatest(a, b), corrected)) AS filtered FROM near)"""


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scene layers: line number - 2 is the reliability, supplier and line number the cell."""
    li = table(spark, sf_dir, "lineitem")
    fill = F.when(F.col("l_partkey") % 11 == 0, F.lit(-3000.0)).otherwise(F.col("l_extendedprice"))
    return li.select(
        F.col("l_orderkey").alias("scene_id"), F.col("l_suppkey").cast("int").alias("row"), F.col("l_linenumber").alias("col"), fill.alias("ndvi"),
        (F.col("l_linenumber") - 2).alias("reliability"),
    )


LAYERS_SQL = """layers AS (
  SELECT l_orderkey AS scene_id, l_suppkey::INT AS "row", l_linenumber AS col, CASE WHEN l_partkey % 11 = 0 THEN -3000.0::DOUBLE ELSE l_extendedprice END AS ndvi,
    l_linenumber - 2 AS reliability FROM lineitem)"""


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells with double-logistic parameters, some out of bounds."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        (k / 40).cast("int").alias("row"), (k % 40).cast("int").alias("col"), (60.0 + F.col("p_size") * 2).alias("xmid_s"), (k % 120).cast("double").alias("scal_s"),
        (F.lit(200.0) + F.col("p_size") * 4).alias("xmid_a"), (5.0 + k % 30).alias("scal_a"), (F.col("p_retailprice") - 950.0).alias("bias"), (F.col("p_retailprice") * 8).alias("scale"),
        F.when(k % 5 != 0, (k % 100) / 100.0).alias("r2"), F.lit(1.0).alias("cov_quality"),
    )


PARAMS_SQL = """params AS (
  SELECT (p_partkey // 40)::INT AS "row", (p_partkey % 40)::INT AS col, 60.0::DOUBLE + p_size * 2 AS xmid_s, (p_partkey % 120)::DOUBLE AS scal_s, 200.0::DOUBLE + p_size * 4 AS xmid_a,
    5.0::DOUBLE + p_partkey % 30 AS scal_a, p_retailprice - 950.0::DOUBLE AS bias, p_retailprice * 8 AS scale, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 100) / 100.0::DOUBLE END AS r2,
    1.0::DOUBLE AS cov_quality FROM part)"""


def orbit(spark: SparkSession, knots: int = 60) -> DataFrame:
    """A synthetic orbital table: time runs backwards, the perihelion is wrapped to 0 to 360 degrees."""
    k = F.col("id").cast("double")
    wrapped = 20.5 + 17.25 * k
    return spark.range(knots).select(
        (-k).alias("kyear"), (0.02 + 0.015 * F.sin(k / 11)).alias("ecc"), (wrapped - 360 * F.floor(wrapped / 360)).alias("omega_deg"), (23.4 + 0.9 * F.cos(k / 7)).alias("epsilon_deg")
    )


def elements(spark: SparkSession, n: int = 40) -> DataFrame:
    """Orbital elements in radians for whole kyears."""
    k = F.col("id").cast("double")
    return spark.range(n).select(
        F.col("id").cast("int").alias("kyear"), (0.02 + 0.015 * F.sin(k / 11)).alias("ecc"), F.radians(23.4 + 0.9 * F.cos(k / 7)).alias("eps_rad"), F.radians(200.5 + 17.25 * k).alias("omega_rad")
    )


ELEMENTS_SQL = """elements AS (
  SELECT range::INT AS kyear, 0.02::DOUBLE + 0.015::DOUBLE * sin(range / 11.0::DOUBLE) AS ecc, radians(23.4::DOUBLE + 0.9::DOUBLE * cos(range / 7.0::DOUBLE)) AS eps_rad,
    radians(200.5::DOUBLE + 17.25::DOUBLE * range) AS omega_rad FROM range(40))"""

#: The knots of ``orbit``, and second derivatives of the not-a-knot splines through them: evenly spaced, the
#: second knot's is a sixth of its right side, as is the last but one's; between them runs a tridiagonal sweep.
SPLINE_SQL = """knots AS (SELECT range AS k, 0.02::DOUBLE + 0.015::DOUBLE * sin(range / 11.0::DOUBLE) AS e, radians(200.5::DOUBLE + 17.25::DOUBLE * range) AS w, 23.4::DOUBLE + 0.9::DOUBLE * cos(range / 7.0::DOUBLE) AS p FROM range(60)),
sides AS MATERIALIZED (SELECT b.k, 6 * (c.e - 2 * b.e + a.e) AS e, 6 * (c.w - 2 * b.w + a.w) AS w, 6 * (c.p - 2 * b.p + a.p) AS p FROM knots b JOIN knots a ON a.k = b.k - 1 JOIN knots c ON c.k = b.k + 1),
down AS (SELECT k, 0.0::DOUBLE AS c, e / 6 AS e, w / 6 AS w, p / 6 AS p FROM sides WHERE k = 1
  UNION ALL SELECT s.k, 1 / (4 - d.c), (s.e - d.e) / (4 - d.c), (s.w - d.w) / (4 - d.c), (s.p - d.p) / (4 - d.c) FROM down d JOIN sides s ON s.k = d.k + 1 WHERE s.k < 58),
up AS (SELECT k, e / 6 AS e, w / 6 AS w, p / 6 AS p FROM sides WHERE k = 58
  UNION ALL SELECT d.k, d.e - d.c * u.e, d.w - d.c * u.w, d.p - d.c * u.p FROM up u JOIN down d ON d.k = u.k - 1),
bent AS (SELECT * FROM up UNION ALL SELECT 0, 2 * a.e - b.e, 2 * a.w - b.w, 2 * a.p - b.p FROM up a, up b WHERE a.k = 1 AND b.k = 2
  UNION ALL SELECT 59, 2 * a.e - b.e, 2 * a.w - b.w, 2 * a.p - b.p FROM up a, up b WHERE a.k = 58 AND b.k = 57),
pieces AS (SELECT y.k, """ + ", ".join(f"y.{c} AS {c}0, z.{c} - y.{c} - (2 * m.{c} + n.{c}) / 6 AS {c}1, m.{c} / 2 AS {c}2, (n.{c} - m.{c}) / 6 AS {c}3" for c in "ewp") + """
  FROM knots y JOIN knots z ON z.k = y.k + 1 JOIN bent m ON m.k = y.k JOIN bent n ON n.k = y.k + 1)"""

#: Daily insolation and longitude of ``days(kyear, day, lat, ecc, eps_rad, omega_rad)``.
INSOLATION_SQL = """sun AS (
  SELECT *, -2 * ((ecc/2 + ecc*ecc*ecc/8) * (1 + sqrt(1 - ecc*ecc)) * sin(-omega_rad) - ecc*ecc/4 * (0.5 + sqrt(1 - ecc*ecc)) * sin(-2*omega_rad)
    + ecc*ecc*ecc/8 * (1.0::DOUBLE/3 + sqrt(1 - ecc*ecc)) * sin(-3*omega_rad)) + (day - 80) * (2 * pi() / 365.2422::DOUBLE) AS mean FROM days),
longitude AS (
  SELECT *, mean + (2*ecc - ecc*ecc*ecc/4) * sin(mean - omega_rad) + 1.25::DOUBLE * ecc*ecc * sin(2 * (mean - omega_rad)) + 13.0::DOUBLE/12 * ecc*ecc*ecc * sin(3 * (mean - omega_rad)) AS lam FROM sun),
declination AS (SELECT *, asin(sin(eps_rad) * sin(lam)) AS delta, radians(lat) AS phi FROM longitude),
hour AS (
  SELECT *, CASE WHEN abs(phi) >= pi()/2 - abs(delta) AND phi * delta > 0 THEN pi() WHEN abs(phi) >= pi()/2 - abs(delta) THEN 0.0::DOUBLE
    ELSE acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, -tan(phi) * tan(delta)))) END AS h FROM declination),
insolation AS (
  SELECT *, 1365.0::DOUBLE / pi() * pow(1 + ecc * cos(lam - omega_rad), 2) / pow(1 - ecc*ecc, 2) * (h * sin(phi) * sin(delta) + cos(phi) * cos(delta) * sin(h)) AS fsw,
    degrees(lam) - 360 * floor(degrees(lam) / 360) AS "lambda" FROM hour)"""
