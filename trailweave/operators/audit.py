"""Quality audit of stitched journeys against raw detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions.scalar import percent
from trailweave.operators.temporal import within_intervals
from trailweave.schema import AuditTargets

FIRST_PREFIXES = ("Z_E",)
LAST_PREFIXES = ("Z_E", "Z_CK")


def coverage(visits: DataFrame, events: DataFrame) -> DataFrame:
    """Events inside closed visits of their zone, counted once for each visit, so that overlaps may exceed
    100 %. ``events``: zone_id, ts_us."""
    hits = within_intervals(events, visits.where("exit_us is not null"), "zone_id", "ts_us", "entry_us", "exit_us")
    mapped = hits.agg(F.count("*").alias("mapped_events"))
    total = events.agg(F.count("*").alias("total_events"))
    return mapped.join(F.broadcast(total)).withColumn("coverage_pct", percent(F.col("mapped_events"), F.col("total_events")))


def _starts(zone: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | zone.startswith(p)
    return found


def first_last_zone(visits: DataFrame) -> DataFrame:
    order = F.struct("entry_us", "event_id")
    return visits.where("person_id is not null").groupBy("person_id").agg(
        F.min_by("zone_id", order).alias("first_zone"), F.max_by("zone_id", order).alias("last_zone")
    )


def completeness(visits: DataFrame) -> DataFrame:
    done = _starts(F.col("first_zone"), FIRST_PREFIXES) & _starts(F.col("last_zone"), LAST_PREFIXES)
    return first_last_zone(visits).agg(
        F.count_if(done).alias("complete_journeys"), F.count("*").alias("total_journeys"), percent(F.count_if(done), F.count("*")).alias("completeness_pct")
    )


def overlap_pairs(visits: DataFrame) -> DataFrame:
    """Visits of one person where the next begins before this one ends."""
    w = Window.partitionBy("person_id").orderBy("entry_us", "event_id")
    nxt = visits.select("person_id", "event_id", "exit_us", F.lead("event_id").over(w).alias("next_event_id"), F.lead("entry_us").over(w).alias("next_entry_us"))
    return nxt.where("next_entry_us < exit_us").select("person_id", "event_id", "next_event_id", (F.col("exit_us") - F.col("next_entry_us")).alias("overlap_us"))


def consistency(visits: DataFrame) -> DataFrame:
    """Persons with one gender, one age and no overlapping visits; a change of person counts before an overlap."""
    w = Window.partitionBy("person_id").orderBy("entry_us", "event_id")
    v = visits.withColumn("clash", F.coalesce(F.lead("entry_us").over(w) < F.col("exit_us"), F.lit(False)))
    per = v.groupBy("person_id").agg(
        F.count_distinct("gender").alias("genders"), F.count_distinct("age_code").alias("ages"), F.bool_or("clash").alias("clash")
    )
    mixed = (F.col("genders") > 1) | (F.col("ages") > 1)
    good = ~mixed & ~F.col("clash")
    return per.agg(
        F.count_if(good).alias("consistent"),
        F.count_if(mixed).alias("demographic_violations"),
        F.count_if(~mixed & F.col("clash")).alias("overlap_violations"),
        F.count("*").alias("total"),
        percent(F.count_if(good), F.count("*")).alias("consistency_pct"),
    )


def audit(visits: DataFrame, events: DataFrame, precision: DataFrame | float = 0.0, targets: AuditTargets = AuditTargets()) -> DataFrame:
    """One row: the four figures, whether each meets its target, and whether all do. ``precision``: numeric
    precision in percent, or a table of one row with numeric_precision_pct; 0 without an insights document.
    Errors are raised, not turned into zeros."""
    row = coverage(visits, events).join(F.broadcast(completeness(visits))).join(F.broadcast(consistency(visits)))
    if isinstance(precision, DataFrame):
        row = row.join(F.broadcast(precision.select("numeric_precision_pct")))
    else:
        row = row.withColumn("numeric_precision_pct", F.lit(float(precision)))
    goals = {n: F.col(f"{n}_pct") >= F.lit(getattr(targets, n)) for n in ("coverage", "completeness", "consistency", "numeric_precision")}
    all_met = F.lit(True)
    for ok in goals.values():
        all_met = all_met & ok
    return row.select(*[f"{n}_pct" for n in goals], *[ok.alias(f"{n}_met") for n, ok in goals.items()], all_met.alias("all_targets_met"))


def stitch_ratios(events: DataFrame, dropped: DataFrame, residual: DataFrame, trajectories: DataFrame) -> DataFrame:
    """One row: detections in all, mapped to a trajectory and recovered by the sweep, with the share of both; and
    trajectories, complete ones, with their share."""
    n = F.count("*")
    row = events.agg(n.alias("total_events")).join(F.broadcast(dropped.agg(n.alias("dropped")))).join(F.broadcast(residual.agg(n.alias("lost"))))
    row = row.join(F.broadcast(trajectories.agg(n.alias("n_trajectories"), F.count_if("is_complete").alias("n_complete"))))
    mapped, recovered = F.col("total_events") - F.col("dropped"), F.col("dropped") - F.col("lost")
    return row.select(
        "total_events",
        mapped.alias("mapped_events"),
        recovered.alias("recovered_events"),
        percent(mapped + recovered, F.col("total_events")).alias("coverage_pct"),
        "n_trajectories",
        "n_complete",
        percent(F.col("n_complete"), F.col("n_trajectories")).alias("completeness_pct"),
    )
