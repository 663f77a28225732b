from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonspark.functions import waveforms
from seasonspark.operators import fitting, series
from seasonspark.operators.orbit import evaluate, not_a_knot, prepared
from seasonspark.sources import text
from seasonspark.plans.adapters import orbit

SAMPLE_CLEAN = [5809, 5809, 2657, 2657, 2657, 2780, 6257, 6346, 6759, 7396, 8015, 8015, 8058, 8015, 8019, 7991, 7991, 7410, 7286, 6416, 5859, 5859, 2094.5]


def rows(spark, values, key="a"):
    return spark.createDataFrame([(key, i, 1 + 16 * i % 365, v) for i, v in enumerate(values)], "key string, seq int, doy int, ndvi double")


def values(df, column):
    return [r[column] for r in df.orderBy("seq").collect()]


def test_sample_cleaned(spark):
    df = series.process(text.sample(spark).select(F.lit("a").alias("key"), F.col("doy").alias("seq"), "doy", "ndvi"), ["key"], ["seq"])
    assert values(df, "filtered") == SAMPLE_CLEAN
    assert df.first().winter_ndvi == 2094.5
    scaled = values(series.process(rows(spark, [1.0, 2.0, 3.0, 4.0]), ["key"], ["seq"], scale=True, quantiles=(0, 1)), "scaled")
    assert min(scaled) == 0 and max(scaled) == 1


@pytest.mark.parametrize("fill", ["all", "winter", "none"])
def test_missing_values(spark, fill):
    got = series.process(rows(spark, [None, 5.0, None, 7.0, None]), ["key"], ["seq"], fill=fill)
    base = got.first().winter_ndvi
    assert base == pytest.approx(5.05)
    assert all(v is not None for v in values(got, "filtered"))
    assert values(got, "corrected")[0] == (None if fill == "none" else base)


def test_all_missing_and_constant(spark):
    got = series.process(rows(spark, [None, None]), ["key"], ["seq"], fill="all", scale=True)
    assert values(got, "filtered") == [None, None] and got.first().winter_ndvi is None
    assert values(series.process(rows(spark, [3.0] * 4), ["key"], ["seq"], scale=True), "scaled") == [0.0] * 4


@pytest.mark.parametrize("size", [3, 5, 7])
def test_median_reflects_its_ends(spark, size):
    v = np.random.default_rng(size).normal(size=11)
    got = rows(spark, [float(x) for x in v]).withColumn("m", series.moving_median(F.col("ndvi"), ["key"], ["seq"], size))
    wide = np.concatenate([v[: size // 2][::-1], v, v[-(size // 2) :][::-1]])
    assert values(got, "m") == pytest.approx([float(np.median(wide[i : i + size])) for i in range(11)])


def test_arrays_equal_rows(spark):
    v = [float(x) for x in np.random.default_rng(1).normal(size=40)]
    df = rows(spark, v)
    arrays = series.to_arrays(df, ["key"], ["seq", "ndvi"]).select(series.array_baseline(F.col("obs.ndvi")).alias("b"), series.array_median3(F.col("obs.ndvi")).alias("m")).first()
    assert arrays.b == pytest.approx(float(np.quantile(v, 0.025)))
    assert arrays.m == pytest.approx(values(df.withColumn("m", series.moving_median(F.col("ndvi"), ["key"], ["seq"])), "m"))


def test_gaps_sort_last_in_the_regional_median(spark):
    df = rows(spark, [1.0, None, 3.0, None, None]).withColumn("m", series.moving_median(F.col("ndvi"), ["key"], ["seq"]))
    assert values(df, "m") == [1.0, 3.0, None, None, None]


T = np.arange(1, 366, 4.0)
TRUE = {
    "double_logistic": (110, 18, 280, 22, 1500, 5000),
    "double_logistic_free": (110, 18, 280, 22, 1500, 5000),
    "cyclic_gaussian": (4000, 190, 50, 1200),
    "cyclic_gaussian_point": (4000, 190, 50, 1200),
    "tanh_sine": (110, 3500, 3000, 3),
    "sawtooth": (105, 45, 245, -55, 1000, 4000),
}


@pytest.mark.parametrize("name", TRUE)
@pytest.mark.parametrize("noise", [0.0, 50.0])
def test_parameters_are_recovered(name, noise):
    model, true = fitting.MODELS[name], np.array(TRUE[name], float)
    y = model.curve(T[None], true[None])[0]
    seen = y + noise * np.random.default_rng(0).normal(size=len(T))
    found = fitting.fit_batch(model, [(T, seen)], 5)[0]
    assert found["status"] == "ok"
    assert found["sse"] <= ((seen - y) ** 2).sum() * 1.001 + 1e-3
    if name != "sawtooth":
        assert found["params"] == pytest.approx(true, rel=0.05 if noise else 1e-3)


def test_sample_reaches_the_known_errors():
    t, y = np.arange(1, 354, 16.0), np.array(text.SAMPLE, float)
    assert fitting.fit_batch(fitting.MODELS["double_logistic_sample"], [(t, y)], 1)[0]["sse"] <= 24795547.9
    assert fitting.fit_batch(fitting.MODELS["cyclic_gaussian"], [(t, y)], 1)[0]["sse"] <= 26002134.3


def test_fit_status_rows(spark):
    obs = [("few", [(1.0, 2.0)] * 3), ("flat", [(float(i), 7.0) for i in range(120)]), ("none", []), ("gaps", [(float(i), None) for i in range(200)]), ("odd", [(1.0, float("nan"))] * 200)]
    df = spark.createDataFrame(obs, "key string, obs array<struct<doy:double,value:double>>")
    got = {r.key: r for r in fitting.fit(df, ["key"], "double_logistic", least=100).collect()}
    assert {k: r.status for k, r in got.items()} == {"few": "few", "flat": "degenerate", "none": "few", "gaps": "few", "odd": "few"}
    assert got["flat"].xmid_s is None


def test_spline_is_exact_on_cubics(spark):
    x = np.array([0, 1, 2.5, 4, 5, 7.0])
    f = lambda v: 1 + 2 * v - v**2 + 0.3 * v**3
    assert not_a_knot(x, f(x)[:, None])[:, 0, 3] == pytest.approx(0.3)
    knots = spark.createDataFrame([(float(v), float(f(v))) for v in x], "x double, y double")
    asked = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 2.5, 6.0, 8.0)], "at double")
    for r in evaluate(asked, "at", knots, "x", ["y"]).collect():
        assert r.y == pytest.approx(f(r.at))


def test_orbit_table_is_unwrapped(spark):
    omega = [r.omega for r in prepared(orbit(spark)).orderBy("kyear").collect()]
    assert np.diff(omega) == pytest.approx(np.radians(17.25))


def test_fits_settle_where_bounds_hold_a_step_up():
    from seasonspark.operators import fitting

    rng = np.random.default_rng(0)
    model, t = fitting.MODELS["double_logistic"], np.tile(np.arange(1, 366, 5.0), (12, 1))
    y, used = rng.uniform(0, 9000, t.shape), np.ones(t.shape, bool)
    start = np.tile(np.array(model.starts(t[0], y[0])[0], float), (12, 1))
    p, sse = fitting.settle(model, t, y, used, start)
    assert (sse <= ((y - y.mean(1, keepdims=True)) ** 2).sum(1) * 1.000001).all()
    for k in range(6):
        for step in (-0.01, 0.01):
            q = p.copy()
            q[:, k] = np.clip(q[:, k] + step * np.abs(q[:, k]), model.low[k], model.high[k])
            assert (((y - model.curve(t, q)) ** 2).sum(1) >= 0.999 * sse).all()


def test_curves_of_fits_and_columns_agree_at_their_jumps(spark):
    """A sample at a jump falls on the same side in both, also where rounding decides."""
    rng = np.random.default_rng(4)
    near = lambda at: at + 365.0 * rng.integers(-800, 800, 40) + rng.integers(-3, 4, 40) * 2.0**-37
    day, width = rng.integers(1, 366, (2, 40)), rng.uniform(20, 400, (2, 40))
    saw = [(166.69935020765885, 47.70475940454837, 105.50000000000003, -101.08401481332737, 0.39, 0.146)]
    saw += list(zip(near(day[0] - 182.5), width[0], near(day[1] + 0.5), -width[1], np.zeros(40), np.ones(40), strict=True))
    wrapped = list(zip(near(day[0]), width[0], near(day[1]), width[1], np.zeros(40), np.ones(40), strict=True))
    t = np.arange(1, 367.0)
    for name, curve, params in (("sawtooth", lambda *p: waveforms.sigmoid_double_sawtooth(*p)[0], saw), ("double_logistic_wrapped", waveforms.double_logistic_wrapped, wrapped)):
        df = spark.createDataFrame([tuple(map(float, p)) for p in params], "a double, b double, c double, d double, e double, f double")
        days = df.withColumn("i", F.monotonically_increasing_id()).withColumn("t", F.explode(F.lit(t.tolist())))
        got = days.select("i", "t", curve(F.col("t"), *map(F.col, "abcdef")).alias("y")).orderBy("i", "t").toPandas()["y"].to_numpy().reshape(-1, len(t))
        assert got == pytest.approx(fitting.MODELS[name].curve(t[None], np.array(params, float)), abs=1e-9)
