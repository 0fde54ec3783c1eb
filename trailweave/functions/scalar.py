"""Column functions of journeys: zones, ages, scores and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailweave.schema import AGE_CODES, CHECKOUT, ENTRANCES, EXITS, UNKNOWN_AGE, ZONE_KINDS, StitchConfig


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def round_even(x: Column, digits: int) -> Column:
    """Half to even on the scaled double, as numpy rounds."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def percent(part: Column, whole: Column) -> Column:
    """Two decimals; 0 of nothing is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(round_even(part * 100.0 / whole, 2))


def zone_kind(zone: Column) -> Column:
    kind = F.lit("unknown")
    for prefix, name in reversed(ZONE_KINDS):
        kind = F.when(zone.startswith(prefix), F.lit(name)).otherwise(kind)
    return kind


def age_code(label: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in AGE_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, label), F.lit(UNKNOWN_AGE))


def is_interior(zone: Column) -> Column:
    return ~zone.startswith("Z_E") & (zone != CHECKOUT)


def is_entrance(zone: Column) -> Column:
    return zone.isin(*ENTRANCES)


def is_exit(zone: Column) -> Column:
    return zone.isin(*EXITS)


def completed(birth_zone: Column, last_zone: Column) -> Column:
    return is_entrance(birth_zone) & is_exit(last_zone)


def place_score(zone: Column, other: Column, adjacent: Column) -> Column:
    """Half for nowhere, one for the same or an adjacent zone, else nothing."""
    return F.when(zone.isNull(), 0.5).when((zone == other) | adjacent, 1.0).otherwise(0.0)


def person_score(same_gender: Column, age_step: Column) -> Column:
    return F.when(same_gender, 0.5).otherwise(0.0) + 0.5 * F.greatest(F.lit(0.0), 1.0 - F.abs(age_step) / 2.0)


def match_score(elapsed: Column, most: Column, place: Column, person: Column, c: StitchConfig = StitchConfig()) -> Column:
    return c.weight_time * (1.0 - elapsed / most) + c.weight_place * place + c.weight_person * person
