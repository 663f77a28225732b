from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonspark.operators import frames, params
from seasonspark.sources import cubes, figures, scenes, schemas, text
from seasonspark.streaming import intake


def test_scene_discovery(spark, tmp_path):
    for n in ("MOD13C1.A2009241.006.hdf", "MOD13C1.A2001321.006.hdf", "MOD13C1.Axxxx.hdf", "other.txt"):
        (tmp_path / n).write_bytes(b"x")
    got = scenes.discover(spark, str(tmp_path)).collect()
    assert [(r.year, r.doy, str(r.acq_date)) for r in got] == [(2001, 321, "2001-11-17"), (2009, 241, "2009-08-29")]
    with pytest.raises(FileNotFoundError):
        scenes.discover(spark, str(tmp_path), "none*")


def test_stack_round_trip_prunes(spark, tmp_path):
    layers = spark.createDataFrame([("s", r, c, float(r), q) for r in range(4) for c, q in enumerate((0, 3, -1))], schemas.SCENE_LAYER)
    when = spark.createDataFrame([("s", 2009, 241)], "scene_id string, year int, doy int")
    scenes.write_stack(scenes.observations(layers, when), str(tmp_path / "stack"))
    back = scenes.read_stack(spark, str(tmp_path / "stack"), 2009, 241)
    assert back.count() == 12 and back.where("ndvi is not null").count() == 4
    plan = back.where("row = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "EqualTo(row,2)" in plan


def test_cube_round_trip(spark, tmp_path):
    cube = np.arange(2 * 3 * 8, dtype=np.float32).reshape(2, 3, 8)
    cube[0, 0, 2] = np.nan
    for key in cubes.KEYS:
        np.savez(tmp_path / f"{key}.npz", **{key: cube})
        df = cubes.read_npz(spark, str(tmp_path / f"{key}.npz"))
        assert df.count() == 6 and df.where("xmid_a is null").count() == 1
    cubes.write_npz(df, str(tmp_path / "out.npz"))
    assert np.array_equal(np.load(tmp_path / "out.npz")["ndvi_fit_all"], cube, equal_nan=True)
    cubes.write_params(df, str(tmp_path / "params"))
    assert spark.read.parquet(str(tmp_path / "params")).count() == 6
    np.savez(tmp_path / "bad.npz", other=cube)
    with pytest.raises(Exception, match="has none of"):
        cubes.read_npz(spark, str(tmp_path / "bad.npz")).count()


def test_schema_guard(spark):
    with pytest.raises(ValueError, match="ndvi double"):
        schemas.assert_schema(spark.createDataFrame([(1,)], "ndvi int"), schemas._struct("ndvi double"))


def test_orbit_text(spark, tmp_path):
    (tmp_path / "orbit").write_text("head\nunits\n  0  0.0167 102.9 23.4 1 2\n -1   0.0170 85.0   23.5\n\nbroken line\n")
    got = sorted(tuple(r) for r in text.read_orbit(spark, str(tmp_path / "orbit")).collect())
    assert got == [(-1.0, 0.017, 85.0, 23.5), (0.0, 0.0167, 102.9, 23.4)]


def test_listing_and_manifest(spark):
    pages = spark.createDataFrame([('<A class=x HREF="a.txt">a</A><a href="../">up</a><a href="?C=N">s</a><a href="d/">d</a><a href=\'b.txt\'>b</a><link href="c.css">',)], "html string")
    listed = text.listed_files(pages)
    assert sorted(r[0] for r in listed.collect()) == ["a.txt", "b.txt"]
    manifest = listed.withColumn("url", text.joined_url(F.lit("http://h/x"), F.col("filename")))
    landed = spark.createDataFrame([("a.txt",), ("a.txt",)], "filename string")
    assert [r.url for r in text.missing(manifest, landed).collect()] == ["http://h/x/b.txt"]
    assert {r.status: r.n for r in text.fetch_counts(manifest, landed).collect()} == {"skipped": 1, "downloaded": 1}


def test_frames_and_bounds(spark):
    p = spark.createDataFrame([(0, 0, 0.0, 1.0, 365.0, 100.0, 10000.0, 10000.1, 0.5, None)], schemas.FIT_PARAMS)
    assert params.constrained(p).first().scale is None and params.constrained(p).first().bias == 10000.0
    assert frames.days(spark).count() == 23
    total = frames.frame_summary(frames.frames(p, [1, 17])).where("doy is null").first()
    assert total.low <= total.high


def test_figure_names(tmp_path):
    assert figures.figure_path(str(tmp_path), "stem", "lat 1.5+2").name == "stem__lat_1p5p2.png"


def test_stream_of_scenes(spark, tmp_path):
    rows = [("s1", 0, 0, 5.0, 0), ("s1", 0, 0, 5.0, 0), ("s1", 0, 1, -3000.0, 0), ("s1", 0, 2, 7.0, 1)]
    df = spark.createDataFrame(rows, "scene_id string, row int, col int, ndvi double, reliability int").withColumn("acquired", F.lit("2009-08-29").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = intake.composites(intake.layers(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("composites").start()
    q.processAllAvailable()
    late = df.where("row = 0 and col = 0").withColumn("acquired", F.lit("2010-08-29").cast("timestamp")).withColumn("scene_id", F.lit("s2"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(20):
        q.processAllAvailable()
        if spark.table("composites").count():
            break
        time.sleep(0.5)
    q.stop()
    got = spark.table("composites").first()
    assert (got.cells, got.valid, got.ndvi) == (3, 2, 6.0)


def test_unreadable_granules_are_left_out():
    from seasonspark.sources.scenes import readable

    good = {"ndvi": np.zeros((2, 3)), "reliability": np.zeros((2, 3))}
    assert readable("a.hdf", False, lambda p: good) is good
    for broken in ({**good, "ndvi": np.zeros((2, 2))}, {"ndvi": np.zeros(3), "reliability": np.zeros(3)}):
        with pytest.warns(UserWarning, match="left out"):
            assert readable("a.hdf", False, lambda p, b=broken: b) is None
        with pytest.raises(ValueError):
            readable("a.hdf", True, lambda p, b=broken: b)


def test_cubes_are_read_and_written_in_bands(spark, tmp_path):
    from seasonspark.sources import cubes

    cube = np.arange(150 * 7 * 8, dtype=np.float32).reshape(150, 7, 8)
    cube[3, 2] = np.nan
    for save, kind in ((np.savez, "f4"), (np.savez_compressed, "f8")):
        save(tmp_path / "a.npz", ndvi_fit_params=cube.astype(kind))
        df = cubes.read_npz(spark, str(tmp_path / "a.npz"))
        assert df.count() == 150 * 7 and df.where("xmid_s IS NULL").count() == 1
        cubes.write_npz(df, str(tmp_path / "b.npz"), band_cells=70)
        with np.load(tmp_path / "b.npz") as back:
            assert np.array_equal(back[cubes.KEYS[0]], cube, equal_nan=True)
    cubes.write_npz(df.where("row < 0"), str(tmp_path / "c.npz"))
    with np.load(tmp_path / "c.npz") as back:
        assert back[cubes.KEYS[0]].shape == (0, 0, 8)


def test_maps_keep_their_metadata(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 1.0, 2.0, 3.0, 4.0, 0.5)], schemas.GAUSSIAN_PARAMS)
    cubes.write_gaussian(rows, str(tmp_path / "maps"), {"source": "stack", "rows": 2})
    listed = {r.name: r.metadata for r in scenes.catalog(spark.read.parquet(str(tmp_path / "maps"))).collect()}
    assert listed["sigma"] == '{"rows": 2, "source": "stack"}' and listed["row"] == "{}"


def test_command_line(spark, tmp_path):
    from seasonspark import __main__ as cli

    obs = spark.range(46).selectExpr("0 AS row", "0 AS col", "int(2001 + id % 2) AS year", "int(1 + 16 * floor(id / 2)) AS doy", "3000 + 4000 * exp(-pow((8 * id - 180) / 60.0D, 2) / 2) AS ndvi")
    scenes.write_stack(obs, str(tmp_path / "stack"))
    cli.main(["fit", str(tmp_path / "stack"), str(tmp_path / "fits")])
    fit = spark.read.parquet(str(tmp_path / "fits")).first()
    assert fit.status == "ok" and abs(fit.mu - 185) < 15 and fit.r2 > 0.95
    cube = spark.createDataFrame([(0, 0, 120.0, 20.0, 270.0, 25.0, 1000.0, 5000.0, 0.9, 1.0)], schemas.FIT_PARAMS)
    cubes.write_params(cube, str(tmp_path / "params"))
    cli.main(["frames", str(tmp_path / "params"), str(tmp_path / "frames"), "--doy-step", "32", "--product", "irg"])
    assert spark.read.parquet(str(tmp_path / "frames")).count() == 12
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "index.html").write_text('<a href="a.txt">a</a> <a href="b.txt">b</a> <a href="../">up</a>')
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "a.txt").write_text("x")
    cli.main(["missing", str(tmp_path / "html"), str(tmp_path / "landed"), str(tmp_path / "todo")])
    assert [r.filename for r in spark.read.parquet(str(tmp_path / "todo")).collect()] == ["b.txt"]
    with pytest.raises(SystemExit):
        cli.arguments(["fit"])
