"""Plans hold what the scale needs: few shuffles, pushed filters, pruned columns, no Python but in fits."""

from __future__ import annotations

import re

import pytest

from seasonspark.plans import queries
from seasonspark.plans.queries import QUERIES

from .conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cleaned_series", "moving_median", "moving_median_5", "scaled_series", "winter_fill"])
def test_cleaning_takes_one_shuffle(spark, name):
    assert len(re.findall(r"Exchange hashpartitioning", plan(QUERIES[name](spark, SF)))) == 1


def test_crop_reaches_the_scan(spark):
    text = plan(QUERIES["quality_histogram"](spark, SF))
    assert "ReadSchema: struct<l_linenumber:int>" in text
    assert "GreaterThanOrEqual(l_linenumber,2)" in plan(queries.grid.crop(queries.A.layers(spark, SF), 20, 60, 2, 6))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("fit_")))
def test_no_python_outside_fits(spark, name):
    assert not re.search(r"Python|Arrow|Pandas", plan(QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", ["double_logistic", "sigmoid_double_sawtooth", "ndvi_frames", "pixel_index", "param_constraints"])
def test_projections_take_no_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF))
