"""Time windows and joins over streams of visits: hourly traffic, sessions, coverage and recovery.

All run in append mode: a row is final once the watermark has passed its window or its partners' time. Rows that
come behind the watermark are left out, and their number is told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.operators.temporal import bucket
from trailweave.schema import StitchConfig
from trailweave.sources.readers import visits_of
from trailweave.streaming.common import EVENTS, run_to_end

US = 1_000_000
COVER_BUCKET_S = 60


def hourly_traffic(visits: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``visits``: ts, person_id. hour_start, unique_visitors and total_visits of each hour: a person's visits in an
    hour first, then the hour's persons."""
    person = visits.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "person_id").agg(F.count("*").alias("n"))
    hour = person.groupBy(F.window(F.window_time("window"), "1 hour")).agg(F.count("person_id").alias("unique_visitors"), F.sum("n").alias("total_visits"))
    return hour.select(F.col("window.start").alias("hour_start"), "unique_visitors", "total_visits")


def sessions(visits: DataFrame, gap: str = "8 hours", delay: str = "1 hour") -> DataFrame:
    """``visits``: ts, person_id. A person's visits with less than ``gap`` between neighbours: start, last and n_visits."""
    found = visits.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "person_id")
    return found.agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n_visits")).select("person_id", "start", "last", "n_visits")


def covered(visits: DataFrame, events: DataFrame, most_stay_s: int = 3600, delay: str = "1 hour") -> DataFrame:
    """Stream-stream interval join: one row for each event in a visit to its zone, both ends included. ``visits``:
    visit_id, zone_id, ts, exit_us, entry_us; ``events``: event_id, zone_id, ts, at_us. Visits are held ``most_stay_s``
    long; none may last longer. A visit comes to each time bucket that it touches, an event to its own, so that a row
    meets its neighbours in time and not all that its zone holds in state."""
    width = COVER_BUCKET_S * US
    touched = F.sequence(bucket(F.col("entry_us"), width), bucket(F.least(F.col("exit_us"), F.col("entry_us") + most_stay_s * US), width))
    v = visits.withWatermark("ts", delay).where("exit_us >= entry_us").select("visit_id", F.col("zone_id").alias("v_zone"), F.col("ts").alias("v_ts"), "entry_us", "exit_us", F.explode(touched).alias("v_bin"))
    e = events.withWatermark("ts", delay).select("event_id", "zone_id", F.col("ts").alias("e_ts"), "at_us", bucket(F.col("at_us"), width).alias("e_bin"))
    near = F.expr(f"zone_id = v_zone and e_bin = v_bin and e_ts >= v_ts and e_ts <= v_ts + interval {most_stay_s} seconds")
    return v.join(e, near & F.expr("at_us between entry_us and exit_us")).select("visit_id", "event_id")


def recovered(dropped: DataFrame, ends: DataFrame, edges: DataFrame, c: StitchConfig = StitchConfig(), delay: str = "1 hour") -> DataFrame:
    """Stream-stream left outer join of dropped detections with trajectory ends near them: (event_id, rule), rule null
    where a key of the detection finds nothing within the window. ``dropped``: event_id, zone_id, gender, ts, entry_us;
    ``ends``: last_zone, gender, ts (of the end), start_us, end_us. Each rule of the sweep is a key of its own: zone and
    gender, neighbouring zone and gender, or the time bin. Ends shrink to the first and last of each key and time bucket before
    they are joined, so a detection meets a few rows however many trajectories end near it."""
    width, s = c.sweep_bin * US, c.sweep_same
    reach = {"same_zone": s * US, "adjacent": s * US, "teleport": c.sweep_teleport * US}
    key = lambda *x: F.concat_ws("|", *[y if not isinstance(y, str) else F.lit(y) for y in x])

    def rule(name: str, k: Column, at: str) -> Column:
        return F.struct(F.lit(name).alias("rule"), k.alias("key"), F.lit(reach[name]).cast("long").alias("reach"), bucket(F.col(at), reach[name]).alias("bin"))

    rules = [rule("same_zone", key("z", F.col("zone_id"), F.col("gender")), "entry_us"), rule("adjacent", key("a", F.col("zone_id"), F.col("gender")), "entry_us")]
    rules.append(rule("teleport", key("t", bucket(F.col("entry_us"), width).cast("string")), "entry_us"))
    d = dropped.withWatermark("ts", delay).select("event_id", F.col("ts").alias("d_ts"), "entry_us", F.explode(F.array(*rules)).alias("r"))
    d = d.select("event_id", "d_ts", "entry_us", F.col("r.rule").alias("asked"), F.col("r.key").alias("d_key"), F.col("r.reach").alias("reach"), F.col("r.bin").alias("d_bin"))
    near = edges.groupBy("a").agg(F.collect_set("b").alias("beside"))  # a zone graph
    t = ends.withWatermark("ts", delay).join(F.broadcast(near), F.col("last_zone") == F.col("a"), "left")
    low, high = F.greatest(bucket(F.col("start_us"), width), bucket(F.col("end_us") - reach["teleport"], width)), bucket(F.col("end_us"), width)
    bins = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))  # only the last ones are near its end
    keys = F.concat(
        F.array(rule("same_zone", key("z", F.col("last_zone"), F.col("gender")), "end_us")),
        F.transform(F.coalesce("beside", F.array().cast("array<string>")), lambda z: rule("adjacent", key("a", z, F.col("gender")), "end_us")),
        F.transform(bins, lambda b: rule("teleport", key("t", b.cast("string")), "end_us")),
    )
    # of the ends of one key in one bucket of its reach the first and the last tell all
    t = t.select("ts", "end_us", F.explode(keys).alias("r")).groupBy(F.window("ts", f"{s} seconds"), F.col("r.key").alias("t_key"), F.col("r.bin").alias("bin"))
    t = t.agg(F.min("end_us").alias("first"), F.max("end_us").alias("final"))
    t = t.select(F.window_time("window").alias("t_ts"), "t_key", "first", "final", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("t_bin"))
    window = F.expr(f"d_key = t_key and d_bin = t_bin and t_ts >= d_ts - interval {s} seconds and t_ts <= d_ts + interval {2 * s} seconds")
    close = (F.col("final") >= F.col("entry_us") - F.col("reach")) & (F.col("first") <= F.col("entry_us") + F.col("reach"))
    return d.join(t, window & close, "left_outer").select("event_id", F.when(F.col("t_key").isNotNull(), F.col("asked")).alias("rule"))


def run_events(spark: SparkSession, source: str, out: str, make, schema: str, late: list[int] | None = None) -> DataFrame:
    """Streams event files through ``make(visits)``, a stream of ``visits_of`` rows with ``ts``, to the end."""

    def build(closing: DataFrame) -> DataFrame:
        return make(timed(visits_of(spark.readStream.schema(EVENTS).parquet(source).unionByName(closing))))

    def last() -> DataFrame:
        return spark.read.schema(EVENTS).parquet(source).agg(F.max("ts").alias("ts")).where("ts is not null")

    return run_to_end(spark, build, out, schema, EVENTS, "ts", last, 3 * 86_400 * US, late)


def timed(visits: DataFrame) -> DataFrame:
    return visits.withColumn("ts", F.timestamp_micros("entry_us"))
