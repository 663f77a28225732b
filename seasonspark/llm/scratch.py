"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="seasonspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        folder = f"file://{folder}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_roots: dict[str, list[str]] = {}
_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession, roots: list[str] | None = None) -> None:
    """Delete the intermediate tables and files under ``roots``, by default all of this application. Results that were not written are lost."""
    mine = _roots.get(spark.sparkContext.applicationId, [])
    gone = list(mine if roots is None else roots)
    _delete(spark, gone)
    mine[:] = [r for r in mine if r not in gone]


@contextmanager
def owned() -> Iterator[list[str]]:
    """Lists the roots of the operator calls made inside, by this thread alone."""
    found: list[str] = []
    token = _owned.set(found)
    try:
        yield found
    finally:
        _owned.reset(token)


class Scratch:
    """Names, writes and drops the intermediate tables of one operator call.

    Results are lazy and read them, so what a result reads stays until ``release`` or until the shared folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        self.paths: list[str] = []
        _roots.setdefault(spark.sparkContext.applicationId, []).append(self.root)
        if (owner := _owned.get()) is not None:
            owner.append(self.root)

    def path(self, name: str) -> str:
        self.made += 1
        self.paths.append(f"{self.root}/{self.made:03d}-{name}")
        return self.paths[-1]

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: cuts the lineage and survives lost executors."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made here that no later plan reads."""
        self._drop([t.scratch_path for t in tables])

    def _drop(self, paths: list[str]) -> None:
        _delete(self.spark, paths)
        self.paths = [p for p in self.paths if p not in paths]

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """Write the result, which has to be slim, and delete every other table made here.

        A collection on the driver then lets Spark remove the shuffle files of the finished plans, which
        else stay on the executors until the driver happens to collect.
        """
        out = self.table(df, name)
        self._drop([p for p in self.paths if p != out.scratch_path])
        self.spark._jvm.java.lang.System.gc()
        return out
