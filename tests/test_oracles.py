"""Every query with SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from seasonspark.plans.queries import ORACLES, QUERIES

from .conftest import SF


def plain(frame):
    cols = sorted(frame.columns)
    values = frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()
    norm = lambda v: None if v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10] if hasattr(v, "year") else v
    return cols, sorted(([norm(v) for v in row] for row in values), key=str)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got, want = plain(QUERIES[name](spark, SF).toPandas()), plain(duck.sql(ORACLES[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, float) for x in a) else a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
