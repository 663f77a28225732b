"""The queries of the seasonal engine. Doubles are rounded, so that the order of sums does not show."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasonspark.functions import names, waveforms
from seasonspark.operators import fitting, frames, grid, orbit, params, phase, quality, series, stats
from seasonspark.plans import adapters as A
from seasonspark.sources import text
from seasonspark.sources.scenes import masked

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEYS, ORDER = ["key"], ["seq"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(x: Column | str, n: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, n) + F.lit(0.0)


def long(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def _processed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return series.process(A.series(spark, sf_dir), KEYS, ORDER, **({"fill": "all"} | options))


# Series cleaning


@query(f"WITH {A.SERIES_SQL} SELECT key::BIGINT AS key, round(quantile_cont(ndvi, 0.025), 6) AS winter_ndvi FROM series GROUP BY key")
def winter_baseline(spark, sf_dir):
    return A.series(spark, sf_dir).groupBy("key").agg(r(F.percentile("ndvi", F.lit(series.QUANTILE))).alias("winter_ndvi"))


@query(f"WITH {A.CLEAN_SQL} SELECT key::BIGINT AS key, id::BIGINT AS id, round(corrected, 6) AS corrected FROM cleaned")
def cleaned_series(spark, sf_dir):
    return _processed(spark, sf_dir).select("key", "id", r("corrected").alias("corrected"))


@query(f"""WITH {A.SERIES_SQL}, based AS (SELECT *, quantile_cont(ndvi, 0.025) OVER (PARTITION BY key) AS base FROM series)
SELECT key::BIGINT AS key, id::BIGINT AS id, (doy >= 300 OR doy <= 60) AS winter, round(CASE WHEN ndvi IS NULL AND (doy >= 300 OR doy <= 60) THEN base ELSE ndvi END, 6) AS filled FROM based""")
def winter_fill(spark, sf_dir):
    df = A.series(spark, sf_dir).withColumn("base", series.baseline(F.col("ndvi"), KEYS))
    return df.select("key", "id", series.in_winter(F.col("doy")).alias("winter"), r(series.filled(F.col("ndvi"), F.col("base"), F.col("doy"), "winter")).alias("filled"))


@query(f"WITH {A.CLEAN_SQL} SELECT key::BIGINT AS key, id::BIGINT AS id, round(filtered, 6) AS filtered FROM filtered")
def moving_median(spark, sf_dir):
    return _processed(spark, sf_dir).select("key", "id", r("filtered").alias("filtered"))


@query(f"""WITH {A.CLEAN_SQL}, five AS (SELECT key, id, n, i, list(corrected) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s
  FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS i FROM cleaned))
SELECT key::BIGINT AS key, id::BIGINT AS id, round(list_sort(list_transform([i-2, i-1, i, i+1, i+2], lambda j: s[CASE WHEN j < 1 THEN 1 - j WHEN j > n THEN 2*n + 1 - j ELSE j END]))[3], 6) AS filtered FROM five""")
def moving_median_5(spark, sf_dir):
    return _processed(spark, sf_dir, median_size=5).select("key", "id", r("filtered").alias("filtered"))


@query(f"""WITH {A.CLEAN_SQL}, limits AS (SELECT *, quantile_cont(filtered, 0.025) OVER (PARTITION BY key) AS lo, quantile_cont(filtered, 0.995) OVER (PARTITION BY key) AS hi FROM filtered)
SELECT key::BIGINT AS key, id::BIGINT AS id, round(CASE WHEN abs(hi - lo) <= 1e-8 THEN 0 ELSE (filtered - lo) / (hi - lo) END, 6) AS scaled FROM limits""")
def scaled_series(spark, sf_dir):
    return _processed(spark, sf_dir, scale=True).select("key", "id", r("scaled").alias("scaled"))


@query(f"WITH {A.CLEAN_SQL} SELECT ((doy - 1) // 16)::BIGINT AS bin, round(avg(filtered), 4) AS ndvi, count(*)::BIGINT AS n FROM filtered GROUP BY 1")
def seasonal_profile(spark, sf_dir):
    bins = long(F.floor((F.col("doy") - 1) / 16))
    return _processed(spark, sf_dir).groupBy(bins.alias("bin")).agg(r(F.avg("filtered"), 4).alias("ndvi"), F.count("*").alias("n"))


@query(f"WITH {A.CLEAN_SQL} SELECT key::BIGINT AS key, year, count(*)::BIGINT AS n, round(avg(filtered), 6) AS ndvi FROM filtered WHERE year BETWEEN 1996 AND 1999 AND filtered IS NOT NULL GROUP BY key, year")
def year_filter(spark, sf_dir):
    kept = _processed(spark, sf_dir).where(F.col("year").between(1996, 1999) & F.col("filtered").isNotNull())
    return kept.groupBy("key", "year").agg(F.count("*").alias("n"), r(F.avg("filtered")).alias("ndvi"))


@query(f"""WITH {A.SERIES_SQL}, one AS (SELECT * FROM series WHERE key = 7 AND ndvi IS NOT NULL)
SELECT doy, {", ".join(f'arg_max(ndvi, struct_pack(a := ts, b := id)) FILTER (WHERE year = {y}) AS "{y}"' for y in range(1996, 2000))} FROM one WHERE year BETWEEN 1996 AND 1999 GROUP BY doy""")
def year_doy_pivot(spark, sf_dir):
    return series.year_table(A.series(spark, sf_dir).where("key = 7"), range(1996, 2000))


@query(f"""WITH {A.CLEAN_SQL}, peaks AS (SELECT key, arg_min(doy, struct_pack(a := -filtered, b := ts, c := id)) AS peak FROM filtered GROUP BY key)
SELECT key::BIGINT AS key, id::BIGINT AS id, peak, ((doy - peak + 183 + 730) % 365)::INT AS turned, ((((doy - peak + 183 + 730) % 365) + peak - 183 + 365) % 365)::INT AS back FROM filtered JOIN peaks USING (key)""")
def recentred_days(spark, sf_dir):
    df = _processed(spark, sf_dir)
    peaks = df.groupBy("key").agg(stats.first_peak(F.col("filtered"), F.col("doy"), F.col("seq")).alias("peak"))
    turned = series.recentred(F.col("doy"), F.col("peak"))
    return df.join(peaks, "key").select("key", "id", "peak", turned.alias("turned"), series.restored(turned, F.col("peak")).alias("back"))


@query(f"WITH {A.SERIES_SQL} SELECT key::BIGINT AS key, round(quantile_cont(ndvi, 0.025), 6) AS winter_ndvi, count(*)::BIGINT AS n FROM series GROUP BY key")
def array_baseline(spark, sf_dir):
    arrays = series.to_arrays(A.series(spark, sf_dir), KEYS, ["seq", "ndvi"])
    return arrays.select("key", r(series.array_baseline(F.col("obs.ndvi"))).alias("winter_ndvi"), long(F.size("obs")).alias("n"))


# Quality, grid, scenes


@query(f"""WITH {A.LAYERS_SQL} SELECT reliability, count(*)::BIGINT AS n, count(CASE WHEN ndvi <> -3000 AND reliability BETWEEN 0 AND 2 THEN 1 END)::BIGINT AS valid,
  round(avg(CASE WHEN ndvi <> -3000 AND reliability BETWEEN 0 AND 2 THEN ndvi END), 4) AS ndvi FROM layers GROUP BY reliability""")
def quality_mask(spark, sf_dir):
    value = quality.reliable(quality.unfilled(F.col("ndvi")), F.col("reliability"))
    return A.layers(spark, sf_dir).groupBy("reliability").agg(F.count("*").alias("n"), F.count(value).alias("valid"), r(F.avg(value), 4).alias("ndvi"))


@query(f"WITH {A.LAYERS_SQL} SELECT reliability, count(*)::BIGINT AS n FROM layers GROUP BY reliability ORDER BY 1")
def quality_histogram(spark, sf_dir):
    return stats.histogram(A.layers(spark, sf_dir), "reliability")


_LAT, _LON = "(c_custkey * 7 % 1900) / 10.0::DOUBLE - 95", "(c_custkey * 13 % 3700) / 10.0::DOUBLE - 185"


@query(f"""WITH p AS (SELECT c_custkey, {_LAT} AS lat, {_LON} AS lon FROM customer),
q AS (SELECT *, trunc((90 - lat) / 0.05::DOUBLE)::INT AS a, trunc((lon + 180) / 0.05::DOUBLE)::INT AS b FROM p)
SELECT c_custkey::BIGINT AS c_custkey, CASE WHEN a >= 0 AND a < 3600 THEN a END AS "row", CASE WHEN b >= 0 AND b < 7200 THEN b END AS col FROM q""")
def pixel_index(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    lat, lon = F.col("c_custkey") * 7 % 1900 / 10.0 - 95, F.col("c_custkey") * 13 % 3700 / 10.0 - 185
    return c.select("c_custkey", grid.row_of(lat).alias("row"), grid.col_of(lon).alias("col"))


@query(f"""WITH {A.LAYERS_SQL} SELECT "row" - 20 AS "row", col - 2 AS col, count(*)::BIGINT AS n, round(sum(ndvi), 2) AS total FROM layers WHERE "row" >= 20 AND "row" < 60 AND col >= 2 AND col < 6 GROUP BY 1, 2""")
def region_crop(spark, sf_dir):
    return grid.crop(A.layers(spark, sf_dir), 20, 60, 2, 6).groupBy("row", "col").agg(F.count("*").alias("n"), r(F.sum("ndvi"), 2).alias("total"))


@query(f"""WITH {A.LAYERS_SQL} SELECT max("row") + 1 AS rows, max(col) + 1 AS cols FROM layers""")
def grid_shape(spark, sf_dir):
    return grid.shape(A.layers(spark, sf_dir))


_SCENE = "concat('MOD13C1.A', year(o_orderdate), lpad(dayofyear(o_orderdate)::VARCHAR, 3, '0'), CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE '.006.' || o_orderkey END, '.hdf')"


@query(f"""WITH files AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'notes.txt' ELSE {_SCENE} END AS file FROM orders),
parts AS (SELECT *, regexp_extract(file, 'A(\\d{{4}})(\\d{{3}})', 1) AS y, regexp_extract(file, 'A(\\d{{4}})(\\d{{3}})', 2) AS d FROM files)
SELECT o_orderkey::BIGINT AS o_orderkey, file, nullif(y, '')::INT AS year, nullif(d, '')::INT AS doy, CASE WHEN y <> '' THEN (make_date(y::INT, 1, 1) + (d::INT - 1))::DATE END AS acq_date FROM parts""")
def scene_dates(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    name = F.concat(F.lit("MOD13C1.A"), F.year("o_orderdate"), names.padded_doy(F.dayofyear("o_orderdate")), F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.concat(F.lit(".006."), "o_orderkey")), F.lit(".hdf"))
    files = o.select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "notes.txt").otherwise(name).alias("file"))
    year, doy = names.scene_part(F.col("file"), 1), names.scene_part(F.col("file"), 2)
    return files.select("o_orderkey", "file", year.alias("year"), doy.alias("doy"), names.date_of(year, doy).alias("acq_date"))


@query("""SELECT year(o_orderdate)::INT AS year, dayofyear(o_orderdate)::INT AS doy, count(*)::BIGINT AS scenes, round(max(o_totalprice), 2) AS high FROM orders
WHERE year(o_orderdate) = 1997 AND dayofyear(o_orderdate) % 16 = 1 GROUP BY 1, 2""")
def time_slice(spark, sf_dir):
    df = A.series(spark, sf_dir).where("year = 1997 AND doy % 16 = 1")
    own = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return df.join(own, "id").groupBy("year", "doy").agg(F.count("*").alias("scenes"), r(F.max("o_totalprice"), 2).alias("high"))


@query(f"""WITH {A.LAYERS_SQL}, scene AS (SELECT o_orderkey AS scene_id, year(o_orderdate)::INT AS year, dayofyear(o_orderdate)::INT AS doy FROM orders)
SELECT year, count(DISTINCT scene_id)::BIGINT AS scenes, count(*)::BIGINT AS cells, count(CASE WHEN ndvi <> -3000 AND reliability BETWEEN 0 AND 2 THEN 1 END)::BIGINT AS valid FROM layers JOIN scene USING (scene_id) GROUP BY year""")
def observation_stack(spark, sf_dir):
    scenes = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_id"), F.year("o_orderdate").alias("year"))
    # Cells are counted per scene first, so that only slim scene rows are joined.
    counted = masked(A.layers(spark, sf_dir)).groupBy("scene_id").agg(F.count("*").alias("cells"), F.count("ndvi").alias("valid"))
    return counted.join(scenes, "scene_id").groupBy("year").agg(F.count("*").alias("scenes"), F.sum("cells").alias("cells"), F.sum("valid").alias("valid"))


@query(f"""WITH {A.LAYERS_SQL}, scene AS (SELECT o_orderkey AS scene_id, year(o_orderdate)::INT AS year, dayofyear(o_orderdate)::INT AS doy FROM orders)
SELECT scene_id::BIGINT AS scene_id, year, doy, CASE WHEN ndvi <> -3000 AND reliability BETWEEN 0 AND 2 THEN ndvi END AS ndvi,
  row_number() OVER (ORDER BY year, doy, scene_id, CASE WHEN ndvi <> -3000 AND reliability BETWEEN 0 AND 2 THEN ndvi END NULLS FIRST)::INT AS place FROM layers JOIN scene USING (scene_id) WHERE "row" = 7 AND col = 3""")
def pixel_series(spark, sf_dir):
    """One location's samples with their place in time order; both filters reach the scan."""
    from_cell = A.layers(spark, sf_dir).where("row = 7 AND col = 3")
    scenes = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_id"), F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("doy"))
    df = masked(from_cell).join(scenes, "scene_id")
    place = F.row_number().over(Window.partitionBy("row", "col").orderBy("year", "doy", "scene_id", "ndvi"))
    return df.select("scene_id", "year", "doy", "ndvi", place.alias("place"))


@query(f"""WITH {A.SERIES_SQL} SELECT key::BIGINT AS key, min(ndvi) AS low, max(ndvi) AS high, round(max(ndvi) - min(ndvi), 6) AS span, arg_min(doy, struct_pack(a := -ndvi, b := ts, c := id)) AS peak FROM series WHERE ndvi IS NOT NULL GROUP BY key""")
def value_range(spark, sf_dir):
    """What the fits start from: extremes, span and the day of the first maximum."""
    df = A.series(spark, sf_dir).where(quality.finite(F.col("ndvi")).isNotNull())
    return df.groupBy("key").agg(F.min("ndvi").alias("low"), F.max("ndvi").alias("high"), r(F.max("ndvi") - F.min("ndvi")).alias("span"), stats.first_peak(F.col("ndvi"), F.col("doy"), F.col("seq")).alias("peak"))


@query("SELECT 'MOD13C1.A' || strftime(o_orderdate, '%Y%j') AS file, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 5")
def first_scenes(spark, sf_dir):
    """The first five scene names and how often each occurs; name order is time order."""
    name = F.concat(F.lit("MOD13C1.A"), F.year("o_orderdate"), names.padded_doy(F.dayofyear("o_orderdate")))
    return A.table(spark, sf_dir, "orders").groupBy(name.alias("file")).agg(F.count("*").alias("n")).orderBy("file").limit(5)


# Parameters and frames

_BOUNDED = ", ".join(f"CASE WHEN {c} BETWEEN {a} AND {b} THEN {c} END AS {c}" for c, (a, b) in params.BOUNDS.items())
_ALL = [*params.BOUNDS, "r2", "cov_quality"]


@query(f"""WITH {A.PARAMS_SQL} SELECT "row", col, {_BOUNDED}, r2, cov_quality FROM params""")
def param_constraints(spark, sf_dir):
    return params.constrained(A.params(spark, sf_dir))


@query(f"WITH {A.PARAMS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS param, count({c})::BIGINT AS before, count(CASE WHEN {c} BETWEEN {a} AND {b} THEN 1 END)::BIGINT AS after FROM params" for c, (a, b) in params.BOUNDS.items()))
def param_kept(spark, sf_dir):
    return params.kept_counts(A.params(spark, sf_dir))


@query(f"WITH {A.PARAMS_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS param, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_pop({c}), 6) AS std FROM params" for c in _ALL))
def param_summary(spark, sf_dir):
    found = params.summary(A.params(spark, sf_dir), _ALL)
    return found.select("param", *(r(c).alias(c) for c in ("min", "max", "mean", "median", "std")))


@query(f"""WITH {A.PARAMS_SQL} SELECT "row", {", ".join(f"round(avg({c}), 6) AS {c}" for c in _ALL)} FROM params GROUP BY "row" """)
def latitude_profile(spark, sf_dir):
    return stats.profile(A.params(spark, sf_dir), _ALL).select("row", *(r(c).alias(c) for c in _ALL))


def _sigma(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def _mod(x: str, p: str = "365") -> str:
    return f"(({x}) - {p} * floor(({x}) / {p}))"


def _safe(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


_DOYS = list(range(1, 366, frames.DOY_STEP))
_DL_SQL = f"bias + scale * ({_sigma(_safe('doy - xmid_s', 'scal_s'))} - {_sigma(_safe('doy - xmid_a', 'scal_a'))})"
_IRG_SQL = f"{_sigma(_safe('doy - xmid_s', 'scal_s'))} * (1 - {_sigma(_safe('doy - xmid_s', 'scal_s'))})"
_FRAMES_SQL = f"WITH {A.PARAMS_SQL}, f AS (SELECT doy::INT AS doy, \"row\", col, {{}} AS value FROM params, range(1, 366, 16) d(doy))"


@query(_FRAMES_SQL.format(_DL_SQL) + ' SELECT doy, "row", col, round(value, 6) AS value FROM f')
def ndvi_frames(spark, sf_dir):
    return frames.frames(A.params(spark, sf_dir), _DOYS).withColumn("value", r("value"))


@query(_FRAMES_SQL.format(_IRG_SQL) + ' SELECT doy, "row", col, round(value, 6) AS value FROM f')
def irg_frames(spark, sf_dir):
    return frames.frames(A.params(spark, sf_dir), _DOYS, frames.irg).withColumn("value", r("value"))


@query(_FRAMES_SQL.format(_DL_SQL) + " SELECT doy, round(min(value), 4) AS low, round(max(value), 4) AS high FROM f GROUP BY ROLLUP (doy)")
def frame_summary(spark, sf_dir):
    found = frames.frame_summary(frames.frames(A.params(spark, sf_dir), _DOYS))
    return found.select("doy", r("low", 4).alias("low"), r("high", 4).alias("high"))


# Waveforms: each event is a time; parameters vary with its id

_T = "(event_id % 7300) / 10.0::DOUBLE - 180"


def _times(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    e = A.table(spark, sf_dir, "events").select("event_id")
    k = F.col("event_id")
    return e, k % 7300 / 10.0 - 180, k


def _wave(expr: str) -> str:
    return f"WITH e AS (SELECT event_id, {_T} AS t FROM events) SELECT event_id::BIGINT AS event_id, {expr} FROM e"


@query(_wave(f"round(1000 + 5000 * ({_sigma('(t - 120) / 20')} - {_sigma('(t - (270 + event_id % 9)) / 25')}), 6) AS value"))
def double_logistic(spark, sf_dir):
    e, t, k = _times(spark, sf_dir)
    return e.select("event_id", r(waveforms.double_logistic(t, 120, 20, 270 + k % 9, 25, 1000, 5000)).alias("value"))


@query(_wave(f"round(1000 + 5000 * (1 / (1 + exp({_mod('t - 120')} / 20)) - 1 / (1 + exp({_mod('t - (270 + event_id % 9)')} / 25))), 6) AS value"))
def double_logistic_wrapped(spark, sf_dir):
    e, t, k = _times(spark, sf_dir)
    return e.select("event_id", r(waveforms.double_logistic_wrapped(t, 120, 20, 270 + k % 9, 25, 1000, 5000)).alias("value"))


@query("SELECT range::INT AS t, " + ", ".join(
    f"round({b} + {s} * ({_sigma(f'(range - {xs}) / {ss}.0::DOUBLE')} - {_sigma(f'(range - {xa}) / {sa}.0::DOUBLE')}), 6) AS {n}" for n, (xs, ss, xa, sa, b, s) in waveforms.HEMISPHERES.items()) + " FROM range(366)")
def hemisphere_curves(spark, sf_dir):
    days = spark.range(366).select(F.col("id").cast("int").alias("t"))
    return days.select("t", *(r(waveforms.double_logistic(F.col("t"), *p)).alias(n) for n, p in waveforms.HEMISPHERES.items()))


@query(_wave("round(3000 + 4000 * tanh((event_id % 6) * sin(2 * pi() * (t - 120) / 365)) / CASE WHEN event_id % 6 = 0 THEN 1 ELSE tanh(event_id % 6) END, 6) AS value"))
def tanh_sine(spark, sf_dir):
    e, t, k = _times(spark, sf_dir)
    return e.select("event_id", r(waveforms.tanh_sine(t, 120, 3000, 4000, (k % 6).cast("double"))).alias("value"))


@query(_wave(f"round(2.5 * (2 * {_sigma('(1 + event_id % 4) * sin(t)')} - 1), 6) AS value"))
def sigmoid_sine(spark, sf_dir):
    e, t, k = _times(spark, sf_dir)
    return e.select("event_id", r(waveforms.sigmoid_sine(t, 2.5, 1 + k % 4)).alias("value"))


@query(_wave(f"round(1000 + 5000 * exp(-0.5 * pow(({_mod('t - (event_id % 365) + 182.5')} - 182.5) / 60, 2)), 6) AS value"))
def cyclic_gaussian(spark, sf_dir):
    e, t, k = _times(spark, sf_dir)
    return e.select("event_id", r(waveforms.cyclic_gaussian(t, 5000, k % 365, 60, 1000)).alias("value"))


def _tooth(x: str, z: str, m: str) -> str:
    return f"({_mod(f'{x} - {z} - 182.5')} - 182.5) * {m}"


_SAWTOOTH_SQL = f"""WITH e AS (SELECT event_id, {_T} AS t, {_mod('100.0::DOUBLE + event_id % 13')} AS z1, {_mod('250.0::DOUBLE - event_id % 17')} AS z2, 1 / 50.0::DOUBLE AS m1, -1 / (40.0::DOUBLE + event_id % 20) AS m2 FROM events),
g AS (SELECT *, {_mod('z2 - z1')} AS way FROM e),
x AS (SELECT *, way * m2 / (m2 - m1) AS a1, (way - 365) * m2 / (m2 - m1) AS a2 FROM g),
c AS (SELECT *, greatest(abs(a1), abs(a2), abs(a1 - way), abs(a2 - way + 365)) < 182.5 AS two, {_mod('z1 + a1')} AS a, {_mod('z1 + a2')} AS b, {_mod('z1 + 182.5')} AS jump FROM x),
d AS (SELECT *, CASE WHEN two THEN least(a, b) ELSE 0 END AS c1, CASE WHEN two THEN greatest(a, b) ELSE 182.5 END AS c2 FROM c),
f AS (SELECT *, ({_mod('t')} >= c1 AND {_mod('t')} < c2) <> (jump > c1 AND jump <= c2) AS first FROM d),
s AS (SELECT *, {_sigma(f"CASE WHEN first THEN {_tooth('t', 'z1', 'm1')} ELSE {_tooth('t', 'z2', 'm2')} END")} AS s, CASE WHEN first THEN m1 ELSE m2 END AS m FROM f)"""


@query(_SAWTOOTH_SQL + " SELECT event_id::BIGINT AS event_id, round(c1, 6) AS c1, round(c2, 6) AS c2, round(0.1 + 0.8 * s, 6) AS value, round(s * (1 - s) * m * 0.8, 6) AS slope FROM s")
def sigmoid_double_sawtooth(spark, sf_dir):
    e, t, k = _times(spark, sf_dir)
    df = waveforms.with_sigmoid_double_sawtooth(e, t, 100.0 + k % 13, 50.0, 250.0 - k % 17, -(40.0 + k % 20), 0.1, 0.8)
    return df.select("event_id", r("first").alias("c1"), r("second").alias("c2"), r("value").alias("value"), r("slope").alias("slope"))


@query(_wave(f"""round({_mod('t')}, 6) AS plain, round({_tooth('t', '120', '2')}, 6) + 0 AS centred,
  round(CASE WHEN {_mod('t')} > 198 AND {_mod('t')} < 344 THEN {_tooth('t', '250', '(-3)')} ELSE {_tooth('t', '120', '2')} END, 6) + 0 AS value"""))
def double_sawtooth(spark, sf_dir):
    e, t, _ = _times(spark, sf_dir)
    return e.select("event_id", r(waveforms.sawtooth(t, 365)).alias("plain"), r(waveforms.centred_sawtooth(t, 365, 120, 2)).alias("centred"), r(waveforms.double_sawtooth(t, 365, 120, 2, 250, -3)).alias("value"))


_GRID_SQL = "WITH x AS (SELECT range AS i, -1 + range * (3.0::DOUBLE / 999) AS x FROM range(1000))"


@query(_GRID_SQL + """, y AS (SELECT i, p, pow(least(greatest(x, 0), 1), p) AS a, pow(1 - least(greatest(x, 0), 1), p) AS b FROM x, (VALUES (0.5::DOUBLE), (1.0), (2.0), (5.0)) v(p))
SELECT i::BIGINT AS i, p AS power, round(sin(2 * pi() * (a / (a + b))), 6) + 0 AS value FROM y""")
def warped_sine(spark, sf_dir):
    x = F.lit(-1.0) + F.col("id") * F.lit(3.0 / 999)
    power = F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0, 5.0))))
    df = spark.range(1000).select(F.col("id").alias("i"), x.alias("x"), power.alias("power"))
    return df.select("i", "power", r(waveforms.warped_sine(F.col("x"), 1, F.col("power"))).alias("value"))


_PHASES = ((0.5, 0.0), (1.0, 0.25), (1.5, 0.5), (2.0, 0.75))


@query(_GRID_SQL + f" SELECT i::BIGINT AS i, p AS strength, ph AS phase, round(sin(2 * pi() * x + p * sin(2 * pi() * (x - ph))), 6) + 0 AS value FROM x, (VALUES {', '.join(f'({p}::DOUBLE, {q}::DOUBLE)' for p, q in _PHASES)}) v(p, ph)")
def phase_modulated_sine(spark, sf_dir):
    x = F.lit(-1.0) + F.col("id") * F.lit(3.0 / 999)
    configs = spark.createDataFrame(_PHASES, "strength double, phase double")
    df = spark.range(1000).select(F.col("id").alias("i"), x.alias("x")).crossJoin(F.broadcast(configs))
    return df.select("i", "strength", "phase", r(waveforms.phase_modulated_sine(F.col("x"), F.col("strength"), F.col("phase"))).alias("value"))


@query(_GRID_SQL + f""" SELECT i::BIGINT AS i, p AS strength, o AS "offset", round({_sigma('5 * sin(2 * pi() * x + p * sin(2 * pi() * (x - 0.25))) + o')}, 6) AS value
FROM x, (VALUES (0.0::DOUBLE), (1.0), (2.0)) v(p), (VALUES (-1.0::DOUBLE), (0.0), (1.0)) w(o)""")
def sigmoid_modulated_sine(spark, sf_dir):
    x = F.lit(-1.0) + F.col("id") * F.lit(3.0 / 999)
    strength, offset = (F.explode(F.array(*map(F.lit, v))) for v in ((0.0, 1.0, 2.0), (-1.0, 0.0, 1.0)))
    df = spark.range(1000).select(F.col("id").alias("i"), x.alias("x"), strength.alias("strength")).select("*", offset.alias("offset"))
    return df.select("i", "strength", "offset", r(waveforms.sigmoid_modulated_sine(F.col("x"), F.col("strength"), F.col("offset"))).alias("value"))


@query(_wave(f"round(1000 + 5000 * ({_sigma('(t - 120) / 20')} - {_sigma('(t - 270) / 25')}), 6) AS dl, round(1000 + 5000 * exp(-0.5 * pow(({_mod('t - 195 + 182.5')} - 182.5) / 60, 2)), 6) AS cg, round({_sigma('(t - 120) / 20')} * (1 - {_sigma('(t - 120) / 20')}), 6) AS irg"))
def sql_functions(spark, sf_dir):
    from seasonspark.functions.sql import register

    register(spark)
    e, t, _ = _times(spark, sf_dir)
    e = e.select("event_id", t.alias("t"))
    return e.selectExpr("event_id", "round(double_logistic(t, 120, 20, 270, 25, 1000, 5000), 6) AS dl", "round(cyclic_gaussian(t, 5000, 195, 60, 1000), 6) AS cg", "round(greenup_rate(t, 120, 20), 6) AS irg")


# Orbit and insolation


@query("""WITH p AS (SELECT user_id, event_id, (value * 7) - 2 * pi() * floor(value * 7 / (2 * pi())) AS phase FROM events),
k AS (SELECT *, ceil((phase - lag(phase) OVER w - pi()) / (2 * pi())) AS k FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id::BIGINT AS user_id, event_id::BIGINT AS event_id, round(phase - 2 * pi() * sum(coalesce(k, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS unwrapped FROM k""")
def phase_unwrap(spark, sf_dir):
    v = F.col("value") * 7
    df = A.table(spark, sf_dir, "events").select("user_id", "event_id", (v - 2 * math.pi * F.floor(v / (2 * math.pi))).alias("phase"))
    return phase.with_unwrapped(df, "phase", ["event_id"], ["user_id"]).select("user_id", "event_id", r("unwrapped").alias("unwrapped"))


def _days_sql(kyears: str, days: int, lats: str) -> str:
    return f"WITH {A.ELEMENTS_SQL}, days AS (SELECT e.*, d.day::INT AS day, l.lat::DOUBLE AS lat FROM elements e, range(1, {days + 1}) d(day), (VALUES {lats}) l(lat) WHERE kyear IN ({kyears})), {A.INSOLATION_SQL}"


def _at(spark: SparkSession, kyears: tuple[int, ...], days: int, lats: tuple[float, ...]) -> DataFrame:
    df = orbit.over_days(A.elements(spark).where(F.col("kyear").isin(*kyears)), days)
    return df.withColumn("lat", F.explode(F.array(*(F.lit(float(x)) for x in lats))))


@query(_days_sql("0, 5, 12", 364, "(65), (-90), (90), (85), (0)") + ' SELECT kyear, lat, day, round(fsw, 6) AS fsw, round("lambda", 6) AS "lambda" FROM insolation')
def insolation_daily(spark, sf_dir):
    found = orbit.insolation(_at(spark, (0, 5, 12), 364, (65, -90, 90, 85, 0)), F.col("lat"))
    return found.select("kyear", "lat", "day", r("fsw").alias("fsw"), r("lambda").alias("lambda"))


@query(_days_sql(", ".join(map(str, range(40))), 365, "(65)") + " SELECT kyear, round(avg(fsw), 6) AS fsw FROM insolation GROUP BY kyear")
def insolation_annual(spark, sf_dir):
    return orbit.annual_mean(A.elements(spark), 65).select("kyear", r("fsw").alias("fsw"))


@query(_days_sql(", ".join(map(str, range(40))), 365, "(65)") + ' SELECT kyear, round(fsw, 6) AS fsw, round(least(fsw, 510), 6) AS clipped, round(ecc, 6) AS ecc, round(degrees(eps_rad), 6) AS obliquity, round("lambda", 6) AS "lambda" FROM insolation WHERE day = 172')
def insolation_clipped(spark, sf_dir):
    df = orbit.insolation(A.elements(spark).withColumn("day", F.lit(172)), 65)
    return df.select("kyear", r("fsw").alias("fsw"), r(orbit.clipped(F.col("fsw"))).alias("clipped"), r("ecc").alias("ecc"), r(F.degrees("eps_rad")).alias("obliquity"), r("lambda").alias("lambda"))


_BY_LONGITUDE = A.INSOLATION_SQL[A.INSOLATION_SQL.index("declination AS") :]


@query(f"""WITH {A.ELEMENTS_SQL}, longitude AS (SELECT e.*, d.day::INT AS day, 65.0::DOUBLE AS lat, d.day * (2 * pi() / 360) AS lam FROM elements e, range(0, 360, 15) d(day)), {_BY_LONGITUDE}
SELECT kyear, day, round(fsw, 6) + 0 AS fsw, round("lambda", 6) + 0 AS "lambda" FROM insolation""")
def insolation_by_longitude(spark, sf_dir):
    """Days given as the sun's longitude in degrees."""
    df = A.elements(spark).withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(345), F.lit(15))))
    found = orbit.insolation(df, 65, "day", day_type=2)
    return found.select("kyear", "day", r("fsw").alias("fsw"), r("lambda").alias("lambda"))


@query(_days_sql("0, 9", 365, "(30)") + " SELECT kyear, day, round(fsw, 6) AS fsw FROM insolation")
def insolation_march21(spark, sf_dir):
    return orbit.insolation(_at(spark, (0, 9), 365, (30,)), F.col("lat")).select("kyear", "day", r("fsw").alias("fsw"))


@query(_days_sql("0, 9, 23", 365, "(30)") + """, s AS (SELECT kyear, 356 - arg_min(day, struct_pack(a := abs("lambda" - 270), b := day)) AS shift FROM insolation GROUP BY kyear),
p AS (SELECT kyear, unnest(range(0, 365 - shift)) AS place FROM s)
SELECT p.kyear, place::INT AS place, round(fsw, 6) AS fsw FROM p JOIN insolation i ON i.kyear = p.kyear AND i.day = p.place % 365 + 1""")
def insolation_dec21(spark, sf_dir):
    df = orbit.december_calendar(A.elements(spark).where("kyear IN (0, 9, 23)"), 30)
    return df.select("kyear", "place", r("fsw").alias("fsw"))


@query(f"""WITH {A.ELEMENTS_SQL}, q AS (SELECT event_id, value / 4 AS kyear FROM events), w AS (SELECT event_id, round_even(kyear * 10, 0)::INT AS idx FROM q)
SELECT event_id::BIGINT AS event_id, round(ecc, 6) AS ecc FROM w LEFT JOIN elements e ON e.kyear = w.idx""")
def orbit_lookup(spark, sf_dir):
    dense = A.elements(spark).withColumnRenamed("kyear", "idx").withColumn("kyear", F.col("idx") / 10)
    asked = A.table(spark, sf_dir, "events").select("event_id", (F.col("value") / 4).alias("kyear"))
    return orbit.lookup(asked, "kyear", dense).select("event_id", r("ecc").alias("ecc"))


_AT = "least(greatest(floor(kyear), 0), 58)"


@query(f"""WITH RECURSIVE {A.SPLINE_SQL}, domain AS (SELECT range::INT AS idx, range / 10.0::DOUBLE AS kyear FROM range(501)), d AS (SELECT idx, kyear, kyear - k AS d, pieces.* FROM domain JOIN pieces ON k = {_AT})
SELECT idx, kyear, round(e0 + d * (e1 + d * (e2 + d * e3)), 9) AS ecc, round(radians(p0 + d * (p1 + d * (p2 + d * p3))), 9) AS eps_rad, round(w0 + d * (w1 + d * (w2 + d * w3)), 9) AS omega_rad FROM d""")
def orbit_spline(spark, sf_dir):
    table = orbit.prepared(A.orbit(spark))
    return orbit.dense(spark, table, 50).select("idx", "kyear", r("ecc", 9).alias("ecc"), r("eps_rad", 9).alias("eps_rad"), r("omega_rad", 9).alias("omega_rad"))


# The dense table meets the knots at whole kyears, so that SQL needs no spline here.
@query("WITH " + A.ELEMENTS_SQL.replace("range(40)", f"range({orbit.DENSE_END + 1})") + f""", days AS (SELECT *, 172 AS day, 65.0::DOUBLE AS lat FROM elements WHERE kyear > 0), {A.INSOLATION_SQL}
SELECT kyear::DOUBLE AS kyear, round(fsw, 3) AS fsw, round(least(fsw, 510), 3) AS clipped, round("lambda", 3) AS "lambda" FROM insolation""")
def insolation_series(spark, sf_dir):
    """The whole analysis: midsummer at 65 degrees north over 5000 kyears."""
    dense = orbit.dense(spark, orbit.prepared(A.orbit(spark, orbit.DENSE_END + 1)))
    asked = spark.range(1, orbit.DENSE_END + 1).select(F.col("id").cast("double").alias("kyear"), F.lit(172).alias("day"))
    found = orbit.insolation(orbit.lookup(asked, "kyear", dense), 65)
    return found.select("kyear", r("fsw", 3).alias("fsw"), r(orbit.clipped(F.col("fsw")), 3).alias("clipped"), r("lambda", 3).alias("lambda"))


@query(ORACLES["insolation_dec21"].replace("SELECT p.kyear,", "SELECT p.kyear::DOUBLE AS kyear,"))
def insolation_dec21_by_kyear(spark, sf_dir):
    """From kyears over the dense table to the shifted calendar."""
    asked = spark.createDataFrame([(0.0,), (9.0,), (23.0,)], "kyear double")
    found = orbit.lookup(asked, "kyear", orbit.dense(spark, orbit.prepared(A.orbit(spark)), 50))
    return orbit.december_calendar(found, 30).select("kyear", "place", r("fsw").alias("fsw"))


# Goodness of fit, fits

_PAIRS_SQL = "SELECT l_linenumber AS key, l_extendedprice AS y, l_quantity * 2000 AS f FROM lineitem"


@query(f"WITH p AS ({_PAIRS_SQL}) SELECT key, count(*)::BIGINT AS n, round(regr_r2(f, y), 6) AS r2 FROM p GROUP BY key")
def r2_pearson(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_linenumber").alias("key")).agg(F.count("*").alias("n"), r(stats.r2_pearson(F.col("l_extendedprice"), F.col("l_quantity") * 2000)).alias("r2"))


@query(f"WITH p AS ({_PAIRS_SQL}) SELECT key, round(1 - sum(pow(y - f, 2)) / (var_pop(y) * count(y)), 6) AS r2 FROM p GROUP BY key")
def r2_sse(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_linenumber").alias("key")).agg(r(stats.r2_sse(F.col("l_extendedprice"), F.col("l_quantity") * 2000)).alias("r2"))


_SHAPE_SQL = f"({_sigma('(doy - 120) / 20.0::DOUBLE')} - {_sigma('(doy - 270) / 25.0::DOUBLE')})"


@query(f"WITH {A.CLEAN_SQL} SELECT key::BIGINT AS key, round(regr_slope(filtered, {_SHAPE_SQL}), 4) AS scale, round(regr_intercept(filtered, {_SHAPE_SQL}), 4) AS bias FROM filtered GROUP BY key")
def linear_amplitude(spark, sf_dir):
    shape = waveforms.double_logistic(F.col("doy"), 120, 20, 270, 25, 0, 1)
    return _processed(spark, sf_dir).groupBy("key").agg(r(F.regr_slope("filtered", shape), 4).alias("scale"), r(F.regr_intercept("filtered", shape), 4).alias("bias"))


class _Fit(NamedTuple):
    """What is fitted: samples ``(key, seq, doy, value)``, the model and the least number of samples."""

    samples: DataFrame
    model: str
    least: int = 1


def _samples(df: DataFrame, value: str = "filtered", doy: str = "doy") -> DataFrame:
    return df.select(*KEYS, "seq", F.col(doy).alias("doy"), F.col(value).alias("value"))


def _fitted(f: _Fit) -> DataFrame:
    return fitting.fit(series.to_arrays(f.samples, KEYS, ["seq", "doy", "value"]), KEYS, f.model, least=f.least)


def _sse(model: str, p: dict[str, Column]) -> Column:
    fitted = getattr(waveforms, CURVES[model])(F.col("doy"), *p.values())
    fitted = fitted[0] if isinstance(fitted, tuple) else fitted
    return F.sum(F.pow(F.col("value") - fitted, F.lit(2.0)))


#: The waveform of each model as columns, and models that are smooth in all parameters.
CURVES = {"double_logistic": "double_logistic", "double_logistic_free": "double_logistic", "double_logistic_sample": "double_logistic", "double_logistic_wrapped": "double_logistic_wrapped", "tanh_sine": "tanh_sine", "sigmoid_sine": "sigmoid_sine", "cyclic_gaussian": "cyclic_gaussian", "cyclic_gaussian_point": "cyclic_gaussian", "sawtooth": "sigmoid_double_sawtooth"}
SMOOTH = frozenset(CURVES) - {"double_logistic_wrapped", "sawtooth"}


def _quality(f: _Fit) -> DataFrame:
    """``(key, n, status, consistent, beats_flat, settled)`` of a fit against its own samples.

    ``consistent``: the waveform as columns has the fit's squared error. ``beats_flat``: it is not above 1.0001 times that of the
    mean. ``settled``: no step of a hundredth of one parameter within the bounds lowers it by a thousandth
    (for smooth models; else null). Null where nothing was fitted.
    """
    model = fitting.MODELS[f.model]
    fits = _fitted(f).select(*KEYS, *model.names, "sse", "status")
    good = f.samples.where("value IS NOT NULL AND doy IS NOT NULL").select(*KEYS, F.col("doy").cast("double").alias("doy"), F.col("value").cast("double").alias("value"))
    own = {n: F.col(n) for n in model.names}
    sums = [F.count("value").alias("n"), _sse(f.model, own).alias("again"), (F.var_pop("value") * F.count("value")).alias("flat")]
    steps = []
    if f.model in SMOOTH:
        for name, low, high in zip(model.names, model.low, model.high, strict=True):
            for step in (-0.01, 0.01):
                moved = F.least(F.greatest(F.col(name) + step * F.greatest(F.abs(F.col(name)), F.lit(1e-6)), F.lit(float(low))), F.lit(float(high)))
                steps.append(f"_{len(steps)}")
                sums.append(_sse(f.model, own | {name: moved}).alias(steps[-1]))
    every = f.samples.select(*KEYS).distinct().join(fits, KEYS, "left")
    found = every.join(good.join(fits, KEYS).groupBy(*KEYS).agg(*sums), KEYS, "left")
    ok = F.col("status") == "ok"
    near = F.abs(F.col("again") - F.col("sse")) <= 1e-6 * F.col("sse") + 1e-9
    settled = F.least(*steps) >= 0.999 * F.col("sse") - 1e-9 if steps else F.lit(None).cast("boolean")
    return found.select(long("key").alias("key"), F.coalesce("n", F.lit(0)).alias("n"), "status", F.when(ok, near).alias("consistent"), F.when(ok, F.col("sse") <= 1.0001 * F.col("flat")).alias("beats_flat"), F.when(ok, settled).alias("settled"))


def fit_query(sql: str | None, model: str, least: int = 1, beats_flat: bool = True) -> Callable[[Callable[[SparkSession, str], _Fit]], Callable]:
    """Registers a fit, and beside it its quality with SQL over ``samples(key, value)``."""

    def add(f: Callable[[SparkSession, str], _Fit]) -> Callable:
        name = f.__name__

        def fit(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _fitted(f(spark, sf_dir))

        def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _quality(f(spark, sf_dir))

        fit.__name__, quality.__name__, fit.__doc__ = name, f"{name}_quality", f.__doc__
        QUERIES[name], QUERIES[quality.__name__] = fit, quality
        if sql:
            status = f"CASE WHEN n < {max(1, least)} THEN 'few' WHEN low = high THEN 'degenerate' ELSE 'ok' END"
            settled = "true" if model in SMOOTH else "NULL::BOOLEAN"
            ORACLES[quality.__name__] = f"""WITH {sql}, counted AS (SELECT key, count(value) AS n, min(value) AS low, max(value) AS high FROM samples GROUP BY key)
SELECT key::BIGINT AS key, n::BIGINT AS n, {status} AS status, CASE WHEN {status} = 'ok' THEN true END AS consistent, CASE WHEN {status} = 'ok' THEN {str(beats_flat).lower()} END AS beats_flat, CASE WHEN {status} = 'ok' THEN {settled} END AS settled FROM counted"""
        return f

    return add


def _filtered_sql(where: str = "true") -> str:
    return f"{A.CLEAN_SQL}, samples AS (SELECT key, filtered AS value FROM filtered WHERE {where})"


_REGION_SQL = f"""{A.SERIES_SQL}, based AS (SELECT *, quantile_cont(ndvi, 0.025) OVER (PARTITION BY key) AS base FROM series),
raised AS (SELECT *, CASE WHEN ndvi < base OR (ndvi IS NULL AND (doy >= 300 OR doy <= 60)) THEN base ELSE ndvi END AS c FROM based),
near AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN c ELSE lag(c) OVER w END AS a, CASE WHEN row_number() OVER v = 1 THEN c ELSE lead(c) OVER w END AS b FROM raised
  WINDOW w AS (PARTITION BY key ORDER BY ts, id), v AS (PARTITION BY key ORDER BY ts DESC, id DESC)),
samples AS (SELECT key, CASE WHEN (a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT < 2 THEN list_sort([a, b, c], 'ASC', 'NULLS LAST')[2] END AS value FROM near WHERE year BETWEEN 1996 AND 2000)"""


@fit_query(_REGION_SQL, "double_logistic", least=100)
def fit_double_logistic(spark, sf_dir):
    """The regional fit: winter gaps alone are filled, several starts, at least 100 samples."""
    df = series.region_cleaned(A.series(spark, sf_dir), KEYS, ORDER)
    return _Fit(_samples(df.where(F.col("year").between(1996, 2000))), "double_logistic", 100)


@fit_query(_filtered_sql("year = 1997"), "double_logistic_free")
def fit_double_logistic_year(spark, sf_dir):
    return _Fit(_samples(_processed(spark, sf_dir).where("year = 1997")), "double_logistic_free")


@fit_query(_filtered_sql("year BETWEEN 1996 AND 2000"), "double_logistic_free")
def fit_double_logistic_years(spark, sf_dir):
    return _Fit(_samples(_processed(spark, sf_dir).where(F.col("year").between(1996, 2000))), "double_logistic_free")


@fit_query(_filtered_sql(), "double_logistic_free")
def fit_peak_centred(spark, sf_dir):
    return _Fit(fitting.peak_centred(_processed(spark, sf_dir), KEYS).select(*KEYS, "seq", "doy", "value"), "double_logistic_free")


@query()
def fit_peak_centred(spark, sf_dir):  # noqa: F811
    """With the day of the peak, which undoes the turn."""
    return fitting.fit_peak_centred(_processed(spark, sf_dir), KEYS)


@fit_query(_filtered_sql("year = 1997"), "double_logistic_wrapped")
def fit_wrapped(spark, sf_dir):
    return _Fit(_samples(_processed(spark, sf_dir).where("year = 1997")), "double_logistic_wrapped")


@fit_query(_filtered_sql("year BETWEEN 1996 AND 2000"), "double_logistic_wrapped")
def fit_wrapped_years(spark, sf_dir):
    return _Fit(_samples(_processed(spark, sf_dir).where(F.col("year").between(1996, 2000))), "double_logistic_wrapped")


@fit_query(_filtered_sql(), "cyclic_gaussian", least=5)
def fit_cyclic_gaussian(spark, sf_dir):
    return _Fit(_samples(_processed(spark, sf_dir)), "cyclic_gaussian", 5)


@fit_query(_filtered_sql("key = 7"), "cyclic_gaussian_point")
def fit_cyclic_gaussian_point(spark, sf_dir):
    return _Fit(_samples(_processed(spark, sf_dir).where("key = 7")), "cyclic_gaussian_point")


@fit_query(_filtered_sql(), "sawtooth")
def fit_sawtooth(spark, sf_dir):
    return _Fit(_samples(_processed(spark, sf_dir, fill="none")), "sawtooth")


@fit_query(_filtered_sql(), "sawtooth")
def fit_sawtooth_scaled(spark, sf_dir):
    return _Fit(_samples(_processed(spark, sf_dir, fill="none", scale=True), "scaled"), "sawtooth")


_LITERAL_SQL = "samples AS (SELECT 0 AS key, unnest([" + ", ".join(map(str, text.SAMPLE)) + "])::DOUBLE AS value)"


def _sample(spark: SparkSession) -> DataFrame:
    return text.sample(spark).select(F.lit(0).alias("key"), F.col("doy").alias("seq"), "doy", F.col("ndvi").alias("value"))


@fit_query(_LITERAL_SQL, "double_logistic_sample")
def fit_sample_logistic(spark, sf_dir):
    return _Fit(_sample(spark), "double_logistic_sample")


@fit_query(_LITERAL_SQL, "tanh_sine")
def fit_tanh_sine(spark, sf_dir):
    return _Fit(_sample(spark), "tanh_sine")


@fit_query("samples AS (SELECT 0 AS key, range AS value FROM range(200))", "sigmoid_sine")
def fit_sigmoid_sine(spark, sf_dir):
    """Recovers amplitude 2.5 and steepness 4 from noisy points on [0, 4 pi]."""
    x = text.spaced(spark, 0.0, 4 * math.pi, 200)
    return _Fit(x.select(F.lit(0).alias("key"), F.col("x").alias("seq"), F.col("x").alias("doy"), (waveforms.sigmoid_sine(F.col("x"), 2.5, 4) + 0.1 * F.randn(42)).alias("value")), "sigmoid_sine")


# Names, listings, intake


@query(f"""WITH p AS (SELECT c_custkey, round({_LAT}, 1) AS lat, round({_LON}, 1) AS lon, c_name FROM customer)
SELECT c_custkey::BIGINT AS c_custkey, translate(printf('lat%.1f_lon%.1f', lat, lon), '+- /.', 'pm_-p') AS tag, translate(c_name || ' +1/2.5', '+- /.', 'pm_-p') AS slug, lpad((c_custkey % 365 + 1)::VARCHAR, 3, '0') AS doy FROM p""")
def slug_tags(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    lat, lon = F.round(F.col("c_custkey") * 7 % 1900 / 10.0 - 95, 1), F.round(F.col("c_custkey") * 13 % 3700 / 10.0 - 185, 1)
    return c.select("c_custkey", names.coordinate_tag(lat, lon).alias("tag"), names.slug(F.concat("c_name", F.lit(" +1/2.5"))).alias("slug"), names.padded_doy(F.col("c_custkey") % 365 + 1).alias("doy"))


@query(r"SELECT page_id::BIGINT AS page_id, regexp_extract(url, '([^/?]+)(\?.*)?$', 1) AS filename FROM pages")
def url_files(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", names.url_file(F.col("url")).alias("filename"))


@query(r"""WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref=["'']([^"'']*)["'']', 1)) AS filename FROM pages)
SELECT filename FROM l WHERE filename NOT IN ('../', './', '/', '') AND filename NOT LIKE '?%' AND filename NOT LIKE '#%' AND filename NOT LIKE '%/'""")
def href_listing(spark, sf_dir):
    return text.listed_files(A.table(spark, sf_dir, "pages"))


@query(r"""WITH m AS (SELECT url, regexp_extract(url, '([^/?]+)(\?.*)?$', 1) AS filename, page_id FROM pages), have AS (SELECT DISTINCT filename FROM m WHERE page_id % 3 = 0)
SELECT url, filename FROM m WHERE filename NOT IN (SELECT filename FROM have)""")
def missing_files(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages")
    manifest = text.to_manifest(pages)
    landed = text.to_manifest(pages.where("page_id % 3 = 0"))
    return text.missing(manifest, landed).select("url", "filename")


@query(r"""WITH m AS (SELECT regexp_extract(url, '([^/?]+)(\?.*)?$', 1) AS filename, page_id FROM pages), have AS (SELECT DISTINCT filename FROM m WHERE page_id % 3 = 0)
SELECT CASE WHEN h.filename IS NULL THEN 'downloaded' ELSE 'skipped' END AS status, count(*)::BIGINT AS n FROM m LEFT JOIN have h USING (filename) GROUP BY 1""")
def fetch_counts(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages")
    return text.fetch_counts(text.to_manifest(pages), text.to_manifest(pages.where("page_id % 3 = 0")))


@query("SELECT (1 + 16 * (i - 1))::DOUBLE AS doy, v::DOUBLE AS ndvi FROM (SELECT unnest([" + ", ".join(map(str, text.SAMPLE)) + "]) AS v, generate_subscripts([" + ", ".join(map(str, text.SAMPLE)) + "], 1) AS i)")
def seasonal_sample(spark, sf_dir):
    return text.sample(spark)


