"""Pass 1: online matching of detections to live trajectories, as a kernel over one gender's time-ordered
detections, and its distributed form.

Every match needs equal gender and a gap under the island gap, so (gender, island) groups hold all eligible
pairs; no group needs another one. A busy store has islands of days: those of more than ``most_at_once`` detections
are cut into epochs, which run apart, each on a guess of the trajectories alive at its beginning, and run again
where the epoch before leaves others than guessed. Ties go to the higher score, then the later sighting, then the lesser id,
and detections are ordered by (time, id): results do not depend on partitions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.functions.scalar import age_code
from trailweave.operators.common import settle
from trailweave.operators.temporal import dense_numbers, islands
from trailweave.schema import ENTRANCES, EXITS, SECOND, ZONE_KINDS, StitchConfig, TRAJECTORY, Zones


@dataclass
class Live:
    """A trajectory while it may still be continued. ``zone`` is None after an exit."""

    id: str
    gender: str
    age: int
    zone: str | None
    seen: int
    moving: bool = False
    complete: bool = False
    visits: list[list] = field(default_factory=list)

    def row(self) -> tuple:
        first, last = self.visits[0], self.visits[-1]
        born = first[0] in ENTRANCES
        done = self.complete or (born and last[0] in EXITS)
        return (self.id, self.gender, self.age, first[1], self.seen, first[0], last[0], len(self.visits), born, done, [tuple(v) for v in self.visits])


def kind_of(zone: str) -> str:
    return next((name for prefix, name in ZONE_KINDS if zone.startswith(prefix)), "unknown")


class Kernel:
    """Feeds on detections in order; gives away trajectories that nothing can continue any more, and counts
    what happens."""

    def __init__(self, zones: Zones, config: StitchConfig = StitchConfig()):
        self.c, self.live, self.pruned_at = config, [], None
        self.zones = {z for a, b, _ in zones.edges for z in (a, b)}
        self.adjacent = {(a, b) for a, b, _ in zones.edges} | {(b, a) for a, b, _ in zones.edges}
        self.counts: dict[str, int] = {}
        self.dropped: list[tuple] = []

    def count(self, what: str) -> None:
        self.counts[what] = self.counts.get(what, 0) + 1

    def _best(self, pool: list[Live], at: int, zone: str, age: int) -> tuple[float, Live | None]:
        best, key, refused = None, (0.0, 0, ""), 0
        still, walk = self.c.still_gap * SECOND, self.c.walk_gap * SECOND
        for t in pool:
            gap, most = at - t.seen, walk if t.moving else still
            if not 0 <= gap <= most:
                continue
            step = abs(t.age - age)
            if step > 1:
                refused += 1
                continue
            place = 0.5 if t.zone is None else float(t.zone == zone or (t.zone, zone) in self.adjacent)
            person = 0.5 + 0.5 * max(0.0, 1 - step / 2)
            s = self.c.weight_time * (1 - gap / most) + self.c.weight_place * place + self.c.weight_person * person
            if s and (best is None or (s, t.seen) > key[:2] or ((s, t.seen) == key[:2] and t.id < key[2])):
                best, key = t, (s, t.seen, t.id)
        if refused:
            self.counts["refused_age"] = self.counts.get("refused_age", 0) + refused
        return key[0], best

    def _prune(self, at: int) -> Iterator[Live]:
        if self.pruned_at is not None and at - self.pruned_at < self.c.prune_every * SECOND:
            return
        self.pruned_at, kept = at, []
        for t in self.live:
            gone = at - t.seen > (self.c.walk_gap if t.moving else self.c.still_gap) * SECOND
            if gone:
                self.count("pruned")
                yield t
            else:
                kept.append(t)
        self.live = kept

    def _drop(self, event: str, at: int, zone: str, gender: str, why: str) -> None:
        self.count(f"dropped_{why}")
        self.dropped.append((event, at, zone, gender, why))

    def feed(self, event: str, at: int, zone: str, kind: str, duration: int | None, gender: str | None, age: int, label: str) -> Iterator[Live]:
        yield from self._prune(at)
        self.count(f"events_{kind if kind in ('entry', 'linger', 'exit') else 'other'}")
        if kind not in ("entry", "linger", "exit"):
            return self._drop(event, at, zone, gender, "kind")
        if zone not in self.zones:
            return self._drop(event, at, zone, gender, "zone")
        mine = [t for t in self.live if t.gender == gender] if gender is not None else []
        if gender is None:
            self.count("refused_gender")
        if kind == "entry":
            score, t = self._best(mine, at, zone, age)
            floor = self.c.entrance_floor if zone in ENTRANCES else self.c.interior_floor
            if t is not None and score >= floor and len(t.visits) >= self.c.most_visits:
                self.count("capped")
                t = None
            if t is not None and score >= floor:
                if t.zone is not None:
                    t.visits[-1][2], t.visits[-1][5] = at - 1, True
                    self.count("ghost_exits")
                self.count("matched_in_zone" if t.zone is not None else "matched_after_exit")
            else:
                t = Live(f"P_{event}", gender, age, zone, at)
                self.live.append(t)
                self.count("born_at_entrance" if zone in ENTRANCES else "born_inside")
                self.count(f"born_in_{kind_of(zone)}")
                self.counts["max_live"] = max(self.counts.get("max_live", 0), len(self.live))
            t.age, t.seen, t.zone, t.moving = age, at, zone, False
            t.visits.append([zone, at, None, 0, label, False])
            return
        _, t = self._best([t for t in mine if t.zone == zone], at, zone, age)
        if t is None:
            return self._drop(event, at, zone, gender, kind)
        self.count(f"matched_{kind}")
        t.seen = at
        if kind == "linger":
            t.visits[-1][3] = max(t.visits[-1][3], duration or 0)
        else:
            t.visits[-1][2], t.zone, t.moving = at, None, True
            t.complete = t.complete or (t.visits[0][0] in ENTRANCES and zone in EXITS)

    def flush(self) -> Iterator[Live]:
        yield from self.live
        self.live = []


DETECTION = ["event_id", "ts_ns", "zone_id", "kind", "duration_s", "gender", "age_code", "age_range"]
OUT = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TRAJECTORY)


def from_events(events: DataFrame) -> DataFrame:
    """Detections of the kernel's shape from typed raw events."""
    ns = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("timestamp")) * 1000
    return events.select(
        "event_id", ns.alias("ts_ns"), "zone_id", F.col("event_type").alias("kind"), "duration_s", "gender", age_code(F.col("age_range")).alias("age_code"), "age_range"
    )


#: One row of the kernel's output: a trajectory ('t'), a detection it could not place ('d') or a counter ('c').
TAGGED = f"tag string, {OUT}, event_id string, ts_ns long, zone_id string, why string, counter string, n long"


def tagged_row(tag: str, **values) -> tuple:
    return (tag, *[values.get(x) for x in TAGGED_REST])


TAGGED_REST = [*[f.name for f in TRAJECTORY], "event_id", "ts_ns", "zone_id", "why", "counter", "n"]


def trajectory_row(row: tuple) -> tuple:
    return tagged_row("t", **dict(zip(TRAJECTORY.names, row)))


def dropped_row(row: tuple) -> tuple:
    return tagged_row("d", **dict(zip(("event_id", "ts_ns", "zone_id", "gender", "why"), row)))


EPOCH = "island long, epoch int, state string"


def in_epochs(detections: DataFrame, c: StitchConfig = StitchConfig()) -> DataFrame:
    """Detections with their island, their epoch in it (of equal length in time, from 0), the last one's number and
    the time at which the epoch ends."""
    known = islands(detections.where("gender is not null").select(*DETECTION), ["gender"], "ts_ns", (c.still_gap + 1) * SECOND, 86_400 * SECOND)
    size = known.groupBy("gender", "island").agg(F.count("*").alias("n"), F.min("ts_ns").alias("begin"), (F.max("ts_ns") + 1).alias("end"))
    size = size.select("gender", "island", "begin", "end", F.ceil(F.col("n") / c.most_at_once).cast("int").alias("n_epochs"))
    length = F.ceil((F.col("end") - F.col("begin")) / F.col("n_epochs")).cast("long")
    epoch = F.call_function("div", F.col("ts_ns") - F.col("begin"), length).cast("int")
    known = known.join(size, ["gender", "island"]).select(
        *DETECTION, "island", epoch.alias("epoch"), (F.col("n_epochs") - 1).alias("last"), (F.col("begin") + (epoch + 1) * length).alias("until")
    )
    lone = detections.where("gender is null").select(*DETECTION, F.pmod(F.xxhash64("event_id"), F.lit(1024)).alias("island"))  # they match nobody
    none = F.lit(0)
    return known.unionByName(lone.select("*", none.alias("epoch"), none.alias("last"), none.cast("long").alias("until")))


def _frozen(live: list[Live]) -> str:
    return json.dumps([[t.id, t.gender, t.age, t.zone, t.seen, t.moving, t.complete, t.visits] for t in sorted(live, key=lambda t: t.id)])


def _run_epochs(rows: DataFrame, zones: Zones, c: StitchConfig) -> DataFrame:
    """The kernel over each (gender, island, epoch), one sorted pass over each partition. A row with a ``state`` comes
    first and tells who is alive. Of all epochs but an island's last, the state at the end is a row 's'."""
    keys = ["gender", "island", "epoch"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("state").isNull(), "ts_ns", "event_id")
    names = ["tag", *TAGGED_REST, "island", "epoch", "state"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel, key, over, out = None, None, None, []

        def put(rows: Iterator[tuple]) -> None:
            out.extend((*row, *key[1:], None) for row in rows)

        def close() -> None:
            last, until = over
            if last:
                put(trajectory_row(t.row()) for t in kernel.flush())
            else:
                kernel.pruned_at = None
                put(trajectory_row(t.row()) for t in kernel._prune(until))
                out.append((*tagged_row("s", gender=key[0]), *key[1:], _frozen(kernel.live)))
            put(tagged_row("c", gender=key[0], counter=k, n=n) for k, n in sorted(kernel.counts.items()))

        for pdf in batches:
            for event, at, zone, kind, duration, gender, age, label, island, epoch, last, until, state in pdf.itertuples(index=False, name=None):
                gender = None if pd.isna(gender) else gender
                if kernel is None or (gender, island, epoch) != key:
                    if kernel is not None:
                        close()
                    kernel, key, over = Kernel(zones, c), (gender, island, epoch), (epoch == last, until)
                if not pd.isna(state):
                    kernel.live = [Live(*x) for x in json.loads(state)]
                    continue
                put(trajectory_row(t.row()) for t in kernel.feed(str(event), int(at), zone, kind, None if pd.isna(duration) else int(duration), gender, int(age), label))
                put(map(dropped_row, kernel.dropped))
                kernel.dropped.clear()
            yield pd.DataFrame(out, columns=names, dtype=object)
            out.clear()
        if kernel is not None:
            close()
        yield pd.DataFrame(out, columns=names, dtype=object)

    return rows.mapInPandas(run, f"{TAGGED}, {EPOCH}")


def tagged(detections: DataFrame, zones: Zones, c: StitchConfig = StitchConfig()) -> DataFrame:
    """All that pass 1 gives; ``parts`` tells the outputs apart.

    The kernel runs over each epoch of each island, at first as if nobody were alive when it begins. Then each
    epoch is given what the one before has left, and those that were given something else run again, until none
    was. An island in one epoch, the usual case, runs once. Once an epoch is right, so is what it leaves; so a
    round settles one more epoch at least, and as trajectories end, a wrong guess is soon forgotten.
    """
    keys = ["gender", "island", "epoch"]
    rows = settle(in_epochs(detections, c).withColumn("state", F.lit(None).cast("string")))
    every, given = settle(_run_epochs(rows, zones, c)), None
    while True:
        left = every.where("tag = 's'").select("gender", "island", (F.col("epoch") + 1).alias("epoch"), "state")
        if given is None:
            changed = left.where("state <> '[]'")
        else:
            changed = left.join(given.withColumnRenamed("state", "before"), keys, "left").where("coalesce(before, '[]') <> state").select(*left.columns)
        changed = settle(changed)
        if changed.isEmpty():
            return every.where("tag <> 's'").select("tag", *TAGGED_REST)
        again = rows.join(changed.select(*keys), keys, "left_semi").select(*rows.columns)
        alive = again.groupBy(*keys).agg(F.first("last").alias("last"), F.first("until").alias("until")).join(changed, keys)
        blank = {"event_id": -1, "ts_ns": -1, "age_code": 0}  # no nulls among numbers, which pandas would make floats
        blanks = [F.lit(blank.get(x)).cast(again.schema[x].dataType).alias(x) for x in DETECTION if x != "gender"]
        new = _run_epochs(again.unionByName(alive.select(*keys, "last", "until", "state", *blanks)), zones, c)
        kept = every.join(changed.select(*keys), keys, "left_anti").select(*every.columns)
        every = settle(kept.unionByName(new))
        given = changed if given is None else settle(given.join(changed.select(*keys), keys, "left_anti").unionByName(changed))


def parts(every: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a ``tagged`` table: trajectories; detections that pass 1 could not place, and why (kind, zone, linger or
    exit); and (counter, n)."""
    n = F.when(F.col("counter").startswith("max_"), F.max("n")).otherwise(F.sum("n"))
    return (
        every.where("tag = 't'").select(*TRAJECTORY.names),
        every.where("tag = 'd'").select("event_id", "ts_ns", "zone_id", "gender", "why"),
        every.where("tag = 'c'").groupBy("counter").agg(n.alias("n")),
    )


def stitch(detections: DataFrame, zones: Zones, c: StitchConfig = StitchConfig()) -> DataFrame:
    """Trajectories after pass 1."""
    return parts(tagged(detections, zones, c))[0]


def dropped(detections: DataFrame, zones: Zones, c: StitchConfig = StitchConfig()) -> DataFrame:
    return parts(tagged(detections, zones, c))[1]


def telemetry(detections: DataFrame, zones: Zones, c: StitchConfig = StitchConfig()) -> DataFrame:
    return parts(tagged(detections, zones, c))[2]


def as_fragments(trajectories: DataFrame) -> DataFrame:
    """Trajectories in the healer's shape, numbered from 1 by birth: by first sighting, then by event number."""
    born = trajectories.withColumn("event", F.regexp_extract("id", r"(\d+)$", 1).cast("long"))
    born = dense_numbers(born, "start_ns", "event", "frag_id", 60 * SECOND, 86_400 * SECOND)
    return born.select(
        "frag_id",
        F.call_function("div", F.col("start_ns"), F.lit(1000).cast("long")).alias("start_us"),
        F.call_function("div", F.col("end_ns"), F.lit(1000).cast("long")).alias("end_us"),
        "birth_zone",
        "last_zone",
        F.col("n_visits").cast("long").alias("n_visits"),
        "gender",
        "age_code",
        "born_at_entrance",
        "is_complete",
        "visits",
    )
