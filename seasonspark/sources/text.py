"""Orbital text tables, directory listings, manifests, the embedded sample, evenly spaced domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonspark.functions.names import url_file

#: The embedded seasonal sample: values on days 1, 17 ... 353. Fixed values.
SAMPLE = (5809, 5809, 2657, 2657, 2657, 2780, 6257, 6346, 6759, 7396, 8015, 8058, 8015, 8058, 7991, 8019, 7991, 7410, 7286, 6416, 5859, 5859, 1407)


def sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1.0 + 16 * i, float(v)) for i, v in enumerate(SAMPLE)], "doy double, ndvi double")


def spaced(spark: SparkSession, start: float, stop: float, n: int, name: str = "x") -> DataFrame:
    """``n`` evenly spaced values with both ends."""
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select((F.lit(float(start)) + F.col("id") * F.lit(step)).alias(name))


def read_orbit(spark: SparkSession, path: str, skip: int = 2) -> DataFrame:
    """The first four numbers of every line after ``skip`` header lines; lines without four numbers are left out.

    Each file is one row of text, so it must fit into memory: such tables have some thousand lines.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).where(F.col("pos") >= skip)
    part = F.split(F.trim("line"), r"\s+")
    names = ("kyear", "ecc", "omega_deg", "epsilon_deg")
    return lines.select(*(F.get(part, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names))).dropna()


def listed_files(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(filename)`` linked from directory listings: quoted targets of anchors without parents, sort links and folders."""
    target = F.explode(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref=["']([^"']*)["']"""), F.lit(1)))
    links = pages.select(target.alias("filename"))
    link = F.col("filename")
    plain = ~link.isin("../", "./", "/", "") & ~link.startswith("?") & ~link.startswith("#") & ~link.endswith("/")
    return links.where(plain).distinct()


def to_manifest(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.select(F.col(url).alias("url"), url_file(F.col(url)).alias("filename"))


def missing(manifest: DataFrame, landed: DataFrame, on: str = "filename") -> DataFrame:
    """What is still to be fetched."""
    return manifest.join(landed.select(on).distinct(), on, "left_anti")


def fetch_counts(manifest: DataFrame, landed: DataFrame, on: str = "filename") -> DataFrame:
    """``(status, n)``: files to download and files skipped since they are there."""
    there = landed.select(on).distinct().withColumn("there", F.lit(True))
    status: Column = F.when(F.col("there"), "skipped").otherwise("downloaded")
    return manifest.join(there, on, "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def joined_url(base: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/*$", "/"), name)
