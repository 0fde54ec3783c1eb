"""Joins over time as equi-joins on time buckets, so that a hot key is spread over its buckets.

A moment has one bucket; an interval or a search window has all buckets that it touches. The exact predicate
stays, and no pair comes twice, since one side of each pair has one bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(t: Column, width: int) -> Column:
    return F.floor(t / F.lit(width)).cast("long")


def within_intervals(events: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int = 600_000_000) -> DataFrame:
    """Events with the intervals of the same key that hold them, both ends included."""
    e = events.withColumn("_b", bucket(F.col(at), width))
    s = spans.where(F.col(end) >= F.col(start)).select(
        F.col(key), F.col(start), F.col(end), F.explode(F.sequence(bucket(F.col(start), width), bucket(F.col(end), width))).alias("_b")
    )
    return e.join(s, [key, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")


def forward(heads: DataFrame, tails: DataFrame, keys: list[str], end: str, start: str, width: int) -> DataFrame:
    """Pairs with equal keys whose tail starts after the head ends and at most ``width`` later. All columns of
    heads are prefixed by a_, those of tails by b_; gap is added."""
    a = heads.select(*[F.col(c).alias(f"a_{c}") for c in heads.columns])
    b = tails.select(*[F.col(c).alias(f"b_{c}") for c in tails.columns])
    first = bucket(F.col(f"a_{end}"), width)
    a = a.withColumn("_b", F.explode(F.array(first, first + 1)))
    b = b.withColumn("_b", bucket(F.col(f"b_{start}"), width))
    on = a["_b"] == b["_b"]
    for k in keys:
        on = on & (a[f"a_{k}"] == b[f"b_{k}"])
    pairs = a.join(b, on).drop("_b").withColumn("gap", F.col(f"b_{start}") - F.col(f"a_{end}"))
    return pairs.where((F.col("gap") > 0) & (F.col("gap") <= width))


def near(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, width: int, how: str = "left_semi") -> DataFrame:
    """Semi or anti join: some row of ``right`` has equal keys and lies within ``width`` on either side.

    A row in the same bucket is near enough, of the bucket before only the latest can tell, of the next one the
    earliest. So ``right`` shrinks to one row for each (keys, bucket), and each row of ``left`` meets at most one.
    """
    if how not in ("left_semi", "left_anti"):
        raise ValueError(f"no such join: {how}")
    r = right.where(F.col(right_at).isNotNull()).groupBy(*[F.col(k).alias(f"_r_{k}") for k in keys], bucket(F.col(right_at), width).alias("_rb"))
    r = r.agg(F.min(right_at).alias("_first"), F.max(right_at).alias("_final"))
    r = r.withColumn("_side", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_rb", F.col("_rb") + F.col("_side"))
    r = r.groupBy(*[f"_r_{k}" for k in keys], "_rb").agg(
        F.max(F.when(F.col("_side") == 1, F.col("_final"))).alias("_before"),
        F.bool_or(F.col("_side") == 0).alias("_here"),
        F.min(F.when(F.col("_side") == -1, F.col("_first"))).alias("_after"),
    )
    on = bucket(F.col(left_at), width) == F.col("_rb")
    for k in keys:
        on = on & (left[k] == F.col(f"_r_{k}"))
    at = F.col(left_at)
    found = F.coalesce(F.col("_here") | (at - F.col("_before") <= width) | (F.col("_after") - at <= width), F.lit(False))
    joined = left.join(r, on, "inner" if how == "left_semi" else "left")
    return joined.where(found if how == "left_semi" else ~found).select(*left.columns)


def islands(events: DataFrame, keys: list[str], at: str, gap: int, day: int = 86_400_000_000) -> DataFrame:
    """Numbers, within each key, the runs of events with less than ``gap`` between neighbours.

    A key with few values (a gender) would put all its rows in one window, so the run starts are found day
    by day: a window over (key, day), the last moment of each earlier day from a small table, then running
    counts of starts by day. The only window over a whole key is that small table.
    """
    e = events.withColumn("_day", bucket(F.col(at), day))
    ends = e.groupBy(*keys, "_day").agg(F.max(at).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_day")
    ends = ends.withColumn("_prev_last", F.lag("_last").over(before)).drop("_last")
    inside = Window.partitionBy(*keys, "_day").orderBy(at)
    e = e.join(ends, [*keys, "_day"]).withColumn("_prev", F.coalesce(F.lag(at).over(inside), F.col("_prev_last")))
    e = e.withColumn("_new", (F.col("_prev").isNull() | (F.col(at) - F.col("_prev") >= gap)).cast("int"))
    starts = e.groupBy(*keys, "_day").agg(F.sum("_new").alias("_n"))
    starts = starts.select(*keys, "_day", (F.sum("_n").over(before) - F.col("_n")).alias("_base"))
    e = e.join(starts, [*keys, "_day"])
    island = F.col("_base") + F.sum("_new").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return e.withColumn("island", island).drop("_day", "_prev", "_prev_last", "_new", "_base")


def dense_numbers(df: DataFrame, at: str, key: str, name: str, width: int = 60_000_000, day: int = 86_400_000_000) -> DataFrame:
    """Adds ``name``: 1, 2, 3, ... in order of (``at``, ``key``) over the whole table.

    Rows are numbered within time buckets, and a bucket's offset is the number of rows before it: of earlier days,
    then of earlier buckets of its day. The only window over everything has one row for each day.
    """
    d = df.withColumn("_bin", bucket(F.col(at), width)).withColumn("_day", bucket(F.col(at), day))
    bins = d.groupBy("_day", "_bin").agg(F.count("*").alias("_n"))
    days = bins.groupBy("_day").agg(F.sum("_n").alias("_n"))
    days = days.select("_day", (F.sum("_n").over(Window.orderBy("_day")) - F.col("_n")).alias("_base"))
    bins = bins.join(days, "_day")
    bins = bins.select("_bin", (F.col("_base") + F.sum("_n").over(Window.partitionBy("_day").orderBy("_bin")) - F.col("_n")).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_bin").orderBy(at, key))
    return d.withColumn("_nth", inside).join(bins, "_bin").withColumn(name, F.col("_base") + F.col("_nth")).drop("_bin", "_day", "_nth", "_base")
