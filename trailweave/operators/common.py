"""Shared helpers of the journey operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Spark's setting that a finished query's shuffle files go at once, not when the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a single-machine session may do without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="trailweave-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this session has written, on whatever file system it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside leave no shuffle files: a loop of small steps would pile them up, one for each
    task of each exchange, until the driver collects its garbage. The session's own setting is back afterwards."""
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def settle(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared folder and cuts its lineage; its shuffle files go.

    A checkpoint keeps the plan's size estimate, which joins multiply, so that over the steps of a loop it
    becomes a number of millions of digits; a new DataFrame over the rows starts without it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    spark = df.sparkSession
    with shuffles_go(spark):
        out = df.select("*").checkpoint(eager=True)._jdf  # a new query: one keeps the setting that it was made with
    return DataFrame(spark._jsparkSession.createDataFrame(out.javaRDD(), out.schema()), spark)
