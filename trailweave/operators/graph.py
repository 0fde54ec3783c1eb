"""The zone graph: adjacency and shortest walks. It has tens of zones, so its tables are broadcast."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.operators.common import settle
from trailweave.schema import Zones
from trailweave.sources.readers import zone_edges


def adjacent_pairs(spark: SparkSession, zones: Zones) -> DataFrame:
    return zone_edges(spark, zones).select("a", "b").distinct()


def walks(zones: Zones) -> dict[tuple[str, str], int]:
    """Least walk seconds between all zones that reach each other, themselves included."""
    near: dict[str, list[tuple[str, int]]] = {}
    for a, b, w in zones.edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    out = {}
    for start in near:
        queue = [(0, start)]
        while queue:
            so_far, zone = heapq.heappop(queue)
            if (start, zone) not in out:
                out[start, zone] = so_far
                for nxt, w in near[zone]:
                    heapq.heappush(queue, (so_far + w, nxt))
    return out


def min_walk(zones: Zones, a: str, b: str) -> int:
    """Raises KeyError for unknown zones and for pairs without a way."""
    return walks(zones)[a, b]


def shortest_paths(spark: SparkSession, zones: Zones) -> DataFrame:
    return spark.createDataFrame([(a, b, w) for (a, b), w in walks(zones).items()], "a string, b string, min_s int")


def observed_edges(visits: DataFrame) -> DataFrame:
    """(a, b, walk_s) in both directions: zones that some person entered one after the other, with the least whole
    seconds between leaving and entering. A visit that begins before the last one ends makes no edge."""
    w = Window.partitionBy("person_id").orderBy("entry_us", "event_id")
    steps = visits.select(F.lag("zone_id").over(w).alias("a"), F.col("zone_id").alias("b"), (F.col("entry_us") - F.lag("exit_us").over(w)).alias("us"))
    steps = steps.where("us >= 0 and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.ceil(F.col("us") / 1_000_000).alias("s"))
    least = steps.groupBy("a", "b").agg(F.min("s").cast("int").alias("walk_s"))
    return least.unionByName(least.select(F.col("b").alias("a"), F.col("a").alias("b"), "walk_s"))


def shortest(edges: DataFrame) -> DataFrame:
    """(a, b, min_s) of all zones that reach each other, themselves included: ways of twice as many steps each round
    until none gets shorter. ``edges``: a, b, walk_s in both directions; a table of zones by zones at most."""
    ways = edges.select("a", "b", F.col("walk_s").alias("min_s")).unionByName(edges.select("a", F.col("a").alias("b"), F.lit(0).alias("min_s")).distinct())
    ways, state = settle(ways), None
    while True:
        on = ways.select(F.col("a").alias("b"), F.col("b").alias("to"), F.col("min_s").alias("more"))
        ways = settle(ways.join(on, "b").groupBy("a", F.col("to").alias("b")).agg(F.min(F.col("min_s") + F.col("more")).alias("min_s")))
        now = tuple(ways.agg(F.count("*"), F.sum("min_s")).first())
        if now == state:
            return ways
        state = now
