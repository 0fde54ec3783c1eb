"""The whole journey pipeline: stitch, heal, sweep, purify."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trailweave.functions.scalar import age_code
from trailweave.operators import audit, sweep
from trailweave.operators import stitch as st
from trailweave.operators.common import settle
from trailweave.operators.heal import heal
from trailweave.schema import StitchConfig, Zones
from trailweave.sources.readers import zone_edges


def run(spark: SparkSession, detections: DataFrame, zones: Zones, c: StitchConfig = StitchConfig(), order: str = "mutual") -> dict[str, DataFrame]:
    """journeys (closed visits), trajectories, residual detections, telemetry and ratios (the stitcher's own coverage
    and completeness). The kernel runs once. What the run's own passes see is counted while they run, by
    observations, not by passes of their own. ``order``: that of healing."""
    edges = zone_edges(spark, zones)
    seen, pure, swept = (Observation() for _ in range(3))
    every = st.tagged(detections, zones, c).observe(seen, *[F.count_if(F.col("tag") == t).alias(n) for t, n in (("t", "fragments"), ("d", "dropped"))])
    found, missed, counters = st.parts(settle(every))
    trajectories = settle(st.as_fragments(found))
    healed, merged = heal(trajectories, edges, c, order)
    healed = settle(healed)
    ages = settle(modes(healed).observe(pure, F.count_if("corrected").alias("corrected_age"), F.count("*").alias("persons")))
    lost = missed.where("why <> 'kind'")
    lost = settle(lost.select("event_id", F.call_function("div", F.col("ts_ns"), F.lit(1000).cast("long")).alias("entry_us"), "zone_id", "gender").observe(swept, F.count("*").alias("lost")))
    rest = settle(sweep.residual(lost, healed, edges, c))
    told = seen.get | pure.get | {f"merged_{k.lower()}": v for k, v in merged.items()} | {"recovered": swept.get["lost"] - rest.count()}
    kinds = missed.where("why = 'kind'").select("event_id", F.lit(None).cast("long").alias("entry_us"), "zone_id", "gender")
    return {
        "journeys": visits_of(healed, ages),
        "trajectories": healed,
        "residual": rest,
        "telemetry": counters.unionByName(spark.createDataFrame(list(told.items()), "counter string, n long")),
        "ratios": audit.stitch_ratios(detections, missed, rest.unionByName(kinds), healed),
    }


def modes(f: DataFrame) -> DataFrame:
    """Each trajectory's most frequent age label (of equals, the one seen first), and whether that corrects its age."""
    v = f.select("frag_id", F.posexplode("visits").alias("pos", "v")).select("frag_id", "pos", F.col("v.age").alias("age_range"))
    age = sweep.mode_first_seen(v, "frag_id", "age_range", ["pos"]).join(f.select("frag_id", "age_code"), "frag_id")
    return age.select("frag_id", "age_range", (age_code(F.col("age_range")) != F.col("age_code")).alias("corrected"))


def visits_of(f: DataFrame, ages: DataFrame | None = None) -> DataFrame:
    """Closed visits of trajectories with the person's most frequent age label; gender is one by construction."""
    v = f.select("frag_id", "gender", "born_at_entrance", "is_complete", F.posexplode("visits").alias("pos", "v"))
    age = (modes(f) if ages is None else ages).select("frag_id", "age_range")
    return v.where("v.exit_ns is not null").join(age, "frag_id", "left").select(
        F.format_string("P_%06d", "frag_id").alias("person_id"),
        F.col("v.zone").alias("zone_id"),
        F.col("v.entry_ns").alias("entry_ns"),
        F.col("v.exit_ns").alias("exit_ns"),
        F.col("v.dwell_s").alias("dwell_s"),
        "gender",
        "age_range",
        "born_at_entrance",
        (~F.col("born_at_entrance")).alias("is_fragment"),
        "is_complete",
        F.col("v.ghost").alias("is_ghost_exit"),
    )
