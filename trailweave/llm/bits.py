"""Bit filters: what is known not to be wanted stays in its map task, the rest goes on to an exact join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import shuffles_go

#: Bits for each key, and the most of all (16 MB, the bound of what is broadcast). With more keys than that many
#: bits serve well, more passes the filter and is sorted out by the join behind it.
PER_KEY = 16
LEAST_LOG, MOST_LOG = 16, 27


class Bits:
    """Which of 2 ** k places keys (spread longs) take; plain data for broadcasting."""

    def __init__(self, data: bytes):
        self.data = data

    def hit(self, keys: np.ndarray) -> np.ndarray:
        at = keys & (len(self.data) * 8 - 1)
        return (np.frombuffer(self.data, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def filter_of(keys: DataFrame):
    """Broadcast ``Bits`` of a settled table of one long column with spread values. Only the words of the
    filter, at most 2 ** MOST_LOG bits, come to the driver."""
    name, spark = keys.columns[0], keys.sparkSession
    with shuffles_go(spark):
        n = keys.count()
    log = min(max((n * PER_KEY - 1).bit_length(), LEAST_LOG), MOST_LOG)
    at = F.col(name).bitwiseAND(F.lit((1 << log) - 1))
    word = F.call_function("shiftright", at, F.lit(5)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(31)).cast("int"))
    with shuffles_go(spark):
        found = keys.groupBy(word.alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (log - 5), "<u4")
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return spark.sparkContext.broadcast(Bits(out.tobytes()))


def may_hold(shared, key: Column) -> Column:
    """True where ``key`` may be among the filter's keys."""

    @F.pandas_udf("boolean")
    def run(keys):
        return type(keys)(shared.value.hit(keys.to_numpy()))

    return run(key)
