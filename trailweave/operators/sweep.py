"""Recovery of dropped detections by nearby trajectories, and purity of demographics.

Recovery only marks detections; journeys stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.operators.temporal import bucket, near
from trailweave.schema import StitchConfig

US = 1_000_000


def same_zone(dropped: DataFrame, f: DataFrame, c: StitchConfig = StitchConfig(), how: str = "left_semi") -> DataFrame:
    """Detections with a trajectory that ended in their zone, of their gender, within the window.
    ``dropped``: event_id, entry_us, zone_id, gender. ``f``: last_zone, gender, end_us."""
    t = f.select(F.col("last_zone").alias("zone_id"), "gender", "end_us")
    return near(dropped, t, ["zone_id", "gender"], "entry_us", "end_us", c.sweep_same * US, how)


def adjacent_zone(dropped: DataFrame, f: DataFrame, edges: DataFrame, c: StitchConfig = StitchConfig(), how: str = "left_semi") -> DataFrame:
    t = f.join(F.broadcast(edges.select(F.col("a").alias("last_zone"), F.col("b").alias("zone_id"))), "last_zone").select("zone_id", "gender", "end_us")
    return near(dropped, t, ["zone_id", "gender"], "entry_us", "end_us", c.sweep_same * US, how)


def teleport(dropped: DataFrame, f: DataFrame, c: StitchConfig = StitchConfig(), how: str = "left_semi") -> DataFrame:
    """Any zone and gender, but within a short time and inside the trajectory's own time bins. Of these only the last
    ones can hold a moment that near to its end, however long a trajectory is."""
    width, reach = c.sweep_bin * US, c.sweep_teleport * US
    last = bucket(F.col("end_us"), width)
    t = f.select("end_us", F.greatest(bucket(F.col("start_us"), width), bucket(F.col("end_us") - reach, width)).alias("_low"), last.alias("_high"))
    t = t.where("_low <= _high").select("end_us", F.explode(F.sequence("_low", "_high")).alias("bin"))
    d = dropped.withColumn("bin", bucket(F.col("entry_us"), width))
    return near(d, t, ["bin"], "entry_us", "end_us", reach, how).drop("bin")


def residual(dropped: DataFrame, f: DataFrame, edges: DataFrame, c: StitchConfig = StitchConfig()) -> DataFrame:
    """Detections that no rule recovers."""
    left = same_zone(dropped, f, c, "left_anti")
    if c.graph_features:
        left = adjacent_zone(left, f, edges, c, "left_anti")
    return teleport(left, f, c, "left_anti")


def mode_first_seen(v: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Each key's most frequent value; of equals, the one seen first. Counts shrink before the shuffle."""
    n = v.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("seen"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), "seen")).alias(value))


def purify(v: DataFrame, key: str = "person_id", order: tuple[str, ...] = ("entry_us", "event_id")) -> DataFrame:
    """Visits with gender and age replaced by their person's mode."""
    out = v
    for value in ("gender", "age_code"):
        out = out.drop(value).join(mode_first_seen(v, key, value, list(order)), key, "left")
    return out.select(*v.columns)
