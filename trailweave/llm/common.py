"""Small helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.operators.common import remove, settle, shared_folder, shuffles_go

__all__ = ["counted", "fold_ascii", "free_memory", "fresh", "gathered", "in_few", "remove", "resident", "settle", "shared_folder", "shuffles_go", "size_of", "table", "text_or_empty", "trim_memory"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front until they clash with no column."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


_RESIDENT: dict[tuple, Any] = {}


def resident(key: tuple, build: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one object at a time, whichever operator needs it, since
    workers outlive stages and their memories would add up."""
    if key not in _RESIDENT:
        free_memory()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def free_memory() -> None:
    """Drops what earlier stages have kept in this Python process and returns free memory to the system."""
    if _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
    trim_memory()


def trim_memory() -> None:
    """Returns free memory to the system. A worker that waits for its next task would hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: A settled table of few rows is read on in tasks of about so many.
GATHERED = 16_384
#: One of few rows with texts, bitmaps or sets, or that compares pairs, in tasks of about so many.
HEAVY = 1024


def in_few(df: DataFrame, rows: int, each: int = GATHERED) -> DataFrame:
    """``df`` in tasks of ``each`` rows or so, or as many as it has, if it has about ``rows`` rows."""
    return df.coalesce(max(1, -(-rows // each)))


def size_of(df: DataFrame) -> int:
    """Rows of a settled table; the query leaves no shuffle files."""
    with shuffles_go(df.sparkSession):
        return df.count()


def counted(df: DataFrame, most: int | None = None, each: int = GATHERED) -> tuple[DataFrame, int]:
    """``settle`` for narrow tables, and the number of rows: few rows do not stay dealt out over a task for each
    partition of the shuffle that made them. Each task still gets ``each`` rows or so; large tables stay as they are.

    ``most``: about how many rows at most the caller expects. Then they are written in few tasks and files too: a file on
    a local disk costs its executor two processes (Hadoop calls chmod), each for a moment as large as the executor.
    """
    if most is not None:
        df = in_few(df, most, each)
    out = settle(df)
    n = size_of(out)
    return in_few(out, n, each), n


def gathered(df: DataFrame, most: int | None = None, each: int = GATHERED) -> DataFrame:
    """The table of ``counted`` alone."""
    return counted(df, most, each)[0]


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII takes the byte-wise path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
