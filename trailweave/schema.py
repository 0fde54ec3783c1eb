"""Schemas and every constant of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("zone_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("duration_s", T.IntegerType()),
        T.StructField("gender", T.StringType()),
        T.StructField("age_range", T.StringType()),
    ]
)

JOURNEYS = T.StructType(
    [
        T.StructField("person_id", T.StringType()),
        T.StructField("zone_id", T.StringType()),
        T.StructField("entry_time", T.TimestampNTZType()),
        T.StructField("exit_time", T.TimestampNTZType()),
        T.StructField("dwell_s", T.DoubleType()),
        T.StructField("gender", T.StringType()),
        T.StructField("age_range", T.StringType()),
        T.StructField("visit_date", T.DateType()),
        T.StructField("hour_of_day", T.IntegerType()),
        T.StructField("is_ghost_exit", T.BooleanType()),
        T.StructField("born_at_entrance", T.BooleanType()),
        T.StructField("is_fragment", T.BooleanType()),
        T.StructField("is_complete", T.BooleanType()),
    ]
)

#: Columns without which journeys can't be analysed.
REQUIRED = ("person_id", "zone_id", "dwell_s", "gender", "visit_date", "hour_of_day", "entry_time")

VISIT = T.StructType(
    [
        T.StructField("zone", T.StringType()),
        T.StructField("entry_ns", T.LongType()),
        T.StructField("exit_ns", T.LongType()),
        T.StructField("dwell_s", T.LongType()),
        T.StructField("age", T.StringType()),
        T.StructField("ghost", T.BooleanType()),
    ]
)

TRAJECTORY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("age_code", T.IntegerType()),
        T.StructField("start_ns", T.LongType()),
        T.StructField("end_ns", T.LongType()),
        T.StructField("birth_zone", T.StringType()),
        T.StructField("last_zone", T.StringType()),
        T.StructField("n_visits", T.IntegerType()),
        T.StructField("born_at_entrance", T.BooleanType()),
        T.StructField("is_complete", T.BooleanType()),
        T.StructField("visits", T.ArrayType(VISIT)),
    ]
)

ENTRANCES = ("Z_E1", "Z_E2")
EXITS = ("Z_E1", "Z_E2", "Z_CK")
CHECKOUTS = ("Z_C1", "Z_C2", "Z_C3", "Z_CK")
CHECKOUT = "Z_CK"
#: Prefix and kind of zone, in the order in which they are asked.
ZONE_KINDS = (("Z_E", "entrance"), ("Z_C", "checkout"), ("Z_N", "navigation"), ("Z_S", "product_section"))
#: Age labels and codes; any other label counts as an adult.
AGE_CODES = {"child": 0, "teenager": 1, "young_adult": 2, "adult": 3, "middle_aged": 4, "senior": 5}
UNKNOWN_AGE = 3

SECOND = 1_000_000_000


@dataclass(frozen=True)
class StitchConfig:
    """Windows in seconds, and weights. Fixed values are those of the published method."""

    walk_gap: int = 45
    still_gap: int = 180
    pool_gap: int = 120
    prune_every: int = 30
    weight_time: float = 0.40
    weight_place: float = 0.38
    weight_person: float = 0.22
    entrance_floor: float = 0.98
    interior_floor: float = 0.50
    most_visits: int = 50
    heal_a: int = 600
    heal_b: int = 240
    heal_c: int = 600
    heal_d: int = 7200
    heal_e: int = 7200
    heal_passes: int = 15
    sweep_same: int = 600
    sweep_teleport: int = 120
    sweep_bin: int = 600
    island_gap: int = 7200
    most_at_once: int = 200_000
    graph_features: bool = True


@dataclass(frozen=True)
class AuditTargets:
    coverage: float = 85.0
    completeness: float = 70.0
    consistency: float = 95.0
    numeric_precision: float = 90.0


@dataclass(frozen=True)
class AnomalyConfig:
    sigma: float = 2.0
    dwell_z: float = 3.0
    least_visits: int = 10
    least_baseline_days: int = 6


@dataclass(frozen=True)
class Zones:
    """A small undirected zone graph: (a, b, walk seconds)."""

    edges: tuple[tuple[str, str, int], ...] = field(default_factory=tuple)


#: The graph of the demonstration data, whose zones come from event types.
DEMO_ZONES = Zones((("Z_E1", "Z_N1", 10), ("Z_N1", "Z_S1", 20), ("Z_S1", "Z_C1", 15), ("Z_C1", "Z_CK", 5), ("Z_E2", "Z_N1", 12)))
#: The graph of the demonstration walks: a store of two wings that meet at the checkouts.
STORE_ZONES = Zones(
    (
        ("Z_E1", "Z_N1", 10), ("Z_E2", "Z_N2", 12), ("Z_N1", "Z_S1", 20), ("Z_N1", "Z_S2", 22), ("Z_N1", "Z_S3", 25), ("Z_N2", "Z_S4", 18),
        ("Z_N2", "Z_S5", 20), ("Z_N2", "Z_S6", 24), ("Z_S1", "Z_C1", 15), ("Z_S2", "Z_C1", 16), ("Z_S3", "Z_C2", 15), ("Z_S4", "Z_C2", 14),
        ("Z_S5", "Z_C3", 15), ("Z_S6", "Z_C3", 15), ("Z_C1", "Z_CK", 5), ("Z_C2", "Z_CK", 5), ("Z_C3", "Z_CK", 5),
    )
)
