"""Command line: fit a stack, render frames, list what is still to be fetched."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonspark.deploy import ship
from seasonspark.operators import fitting, frames, series
from seasonspark.sources import scenes, text


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("seasonspark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    fit = commands.add_parser("fit", help="clean a stack of observations and fit a model to every cell")
    fit.add_argument("stack")
    fit.add_argument("output")
    fit.add_argument("--model", choices=sorted(fitting.MODELS), default="cyclic_gaussian")
    fit.add_argument("--min-samples", type=int, default=5)
    fit.add_argument("--fill", choices=("all", "winter", "none"), default="none")
    shown = commands.add_parser("frames", help="NDVI or green-up rate of every cell on days of the year")
    shown.add_argument("params")
    shown.add_argument("output")
    shown.add_argument("--product", choices=("ndvi", "irg"), default="ndvi")
    shown.add_argument("--doy-step", type=int, default=frames.DOY_STEP)
    missing = commands.add_parser("missing", help="files of landed directory listings that are not in a folder; nothing is fetched")
    missing.add_argument("listings", help="folder of HTML pages")
    missing.add_argument("landed", help="folder of fetched files")
    missing.add_argument("output")
    return parser.parse_args(argv)


def fitted(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    keys = ["row", "col"]
    cleaned = series.process(scenes.read_stack(spark, a.stack), keys, ["year", "doy"], fill=a.fill)
    samples = cleaned.select(*keys, F.struct("year", "doy").alias("seq"), "doy", F.col("filtered").alias("value"))
    return fitting.fit(series.to_arrays(samples, keys, ["seq", "doy", "value"]), keys, a.model, least=a.min_samples)


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.command == "fit":
        return fitted(spark, a)
    if a.command == "frames":
        model = frames.ndvi if a.product == "ndvi" else frames.irg
        return frames.frames(spark.read.parquet(a.params), range(1, 366, a.doy_step), model)
    pages = spark.read.text(a.listings, wholetext=True).withColumnRenamed("value", "html")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.landed)
    return text.missing(text.listed_files(pages), there.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename")))


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("seasonspark").getOrCreate()
    ship(spark)
    run(spark, a).write.mode("overwrite").parquet(a.output)


if __name__ == "__main__":
    main()
