"""The micro fixtures of the matching rules: times in seconds, ages as codes."""

import random

import pytest
from pyspark.sql import functions as F

from trailweave.operators import graph, heal, stitch, sweep
from trailweave.plans import journey
from trailweave.sources import readers
from trailweave.operators.temporal import dense_numbers
from trailweave.schema import AGE_CODES, DEMO_ZONES, SECOND, STORE_ZONES, StitchConfig, Zones

G = Zones((("Z_E1", "Z_N1", 10), ("Z_N1", "Z_S1", 20), ("Z_S1", "Z_CK", 15), ("Z_E2", "Z_N1", 12), ("Z_N1", "Z_S2", 25)))


def live(*events, config=StitchConfig()):
    kernel, out = stitch.Kernel(G, config), []
    for i, (at, zone, kind, gender, age, *duration) in enumerate(events):
        out += [t.row() for t in kernel.feed(str(i), at * SECOND, zone, kind, duration[0] if duration else None, gender, age, f"a{age}")]
    return kernel, out + [t.row() for t in kernel.flush()]


def n_visits(*events):
    return sorted(r[7] for r in live(*events)[1])


def test_adjacent_entry_closes_the_visit_before():
    kernel, rows = live((0, "Z_E1", "entry", "F", 3), (180, "Z_N1", "entry", "F", 3))
    assert len(rows) == 1 and rows[0][10][0][2] == 180 * SECOND - 1 and rows[0][10][0][5] and kernel.counts["ghost_exits"] == 1


@pytest.mark.parametrize(
    "first, second, joined",
    [
        ((0, "Z_E1", "entry", "F", 3), (181, "Z_N1", "entry", "F", 3), False),
        ((0, "Z_E1", "entry", "F", 3), (54, "Z_S1", "entry", "F", 3), True),
        ((0, "Z_E1", "entry", "F", 3), (55, "Z_S1", "entry", "F", 3), False),
        ((0, "Z_E1", "entry", "F", 3), (29, "Z_S1", "entry", "F", 4), True),
        ((0, "Z_E1", "entry", "F", 3), (30, "Z_S1", "entry", "F", 4), False),
        ((0, "Z_E1", "entry", "F", 3), (9, "Z_E1", "entry", "F", 3), True),
        ((0, "Z_E1", "entry", "F", 3), (10, "Z_E1", "entry", "F", 3), False),
        ((0, "Z_E1", "entry", "F", 3), (1, "Z_E1", "entry", "F", 4), False),
        ((0, "Z_E1", "entry", "F", 3), (5, "Z_N1", "entry", "M", 3), False),
    ],
)
def test_entry_limits(first, second, joined):
    assert n_visits(first, second) == ([2] if joined else [1, 1])


@pytest.mark.parametrize("at, age, joined", [(44, 3, True), (45, 3, False), (38, 4, True), (39, 4, False)])
def test_entry_after_an_exit(at, age, joined):
    assert n_visits((0, "Z_E1", "entry", "F", 3), (10, "Z_E1", "exit", "F", 3), (at, "Z_CK", "entry", "F", age)) == ([2] if joined else [1, 1])


def test_null_gender_matches_nobody():
    kernel, rows = live((0, "Z_E1", "entry", None, 3), (5, "Z_E1", "linger", None, 3))
    assert len(rows) == 1 and kernel.counts["dropped_linger"] == 1


def test_linger_keeps_the_longest_stay():
    _, rows = live((0, "Z_N1", "entry", "F", 3), (10, "Z_N1", "linger", "F", 3, 40), (20, "Z_N1", "linger", "F", 3, 25))
    assert rows[0][10][0][3] == 40 and rows[0][4] == 20 * SECOND


def test_unknown_kind_and_zone_are_dropped():
    kernel, rows = live((0, "Z_N1", "blink", "F", 3), (1, "Z_X9", "entry", "F", 3))
    assert not rows and kernel.counts["dropped_kind"] == kernel.counts["dropped_zone"] == 1


def test_visit_cap():
    events = [(5 * i, "Z_N1" if i % 2 else "Z_S1", "entry", "F", 3) for i in range(60)]
    assert n_visits(*events) == [10, 50]


def slow_pass1(rows, zones):
    """Pass 1 by its rules, written anew over plain lists: every detection looks at every trajectory there is."""
    near = {frozenset((a, b)) for a, b, _ in zones.edges}
    known = {z for a, b, _ in zones.edges for z in (a, b)}
    people, lost = [], []
    for at, event, zone, kind, duration, gender, age in sorted(rows, key=lambda r: (r[0], int(r[1]))):
        if kind not in ("entry", "linger", "exit") or zone not in known:
            lost.append((event, "kind" if kind not in ("entry", "linger", "exit") else "zone"))
            continue
        best = None
        for p in people:
            inside = p["out"] is False
            limit = (180 if inside else 45) * SECOND
            gap, step = at - p["seen"], abs(p["age"] - age)
            if gender is None or p["gender"] != gender or step > 1 or gap > limit or (kind != "entry" and not (inside and p["visits"][-1][0] == zone)):
                continue
            place = 0.5 if not inside else float(p["visits"][-1][0] == zone or frozenset((p["visits"][-1][0], zone)) in near)
            score = 0.40 * (1 - gap / limit) + 0.38 * place + 0.22 * (0.5 + 0.5 * (1 - step / 2))
            if best is None or (score, p["seen"]) > best[0] or ((score, p["seen"]) == best[0] and p["id"] < best[1]["id"]):
                best = (score, p["seen"]), p
        if kind != "entry":
            if best is None:
                lost.append((event, kind))
                continue
            p = best[1]
            p["seen"] = at
            if kind == "linger":
                p["visits"][-1][3] = max(p["visits"][-1][3], duration or 0)
            else:
                p["visits"][-1][2], p["out"] = at, True
            continue
        floor = 0.98 if zone in ("Z_E1", "Z_E2") else 0.50
        if best is not None and best[0][0] >= floor and len(best[1]["visits"]) < 50:
            p = best[1]
            if not p["out"]:
                p["visits"][-1][2] = at - 1
        else:
            p = {"id": f"P_{event}", "gender": gender, "visits": []}
            people.append(p)
        p["visits"].append([zone, at, None, 0])
        p.update(age=age, seen=at, out=False)
    return {(p["id"], p["gender"], p["age"], p["seen"], tuple(map(tuple, p["visits"]))) for p in people}, set(lost)


@pytest.mark.parametrize("seed", [1, 2])
def test_pass1_is_its_rules(spark, seed):
    rng, rows = random.Random(seed), []
    for i in range(600):
        zone = rng.choice(["Z_E1", "Z_N1", "Z_S1", "Z_C1", "Z_CK", "Z_E2"] + ["Z_X"] * (i % 50 == 0))
        kind = rng.choice(["entry", "entry", "linger", "exit"] + ["blink"] * (i % 60 == 0))
        rows.append((rng.randrange(0, 9000, 3) * SECOND, str(i), zone, kind, rng.choice([None, 5, 40]), rng.choice(["F", "M", "M", None]), rng.randrange(6)))
    want, lost = slow_pass1(rows, DEMO_ZONES)
    d = spark.createDataFrame([(int(e), t, z, k, n, g, a, "adult") for t, e, z, k, n, g, a in rows], "event_id long, ts_ns long, zone_id string, kind string, duration_s long, gender string, age_code int, age_range string")
    found, missed, counters = stitch.parts(stitch.tagged(d, DEMO_ZONES))
    got = {(r.id, r.gender, r.age_code, r.end_ns, tuple((v.zone, v.entry_ns, v.exit_ns, v.dwell_s) for v in r.visits)) for r in found.collect()}
    assert got == want and max(len(p[4]) for p in want) > 3
    assert {(r.event_id, r.why) for r in missed.collect()} == lost
    n = {r.counter: r.n for r in counters.collect()}
    assert n["born_at_entrance"] + n["born_inside"] == len(want) and sum(v for k, v in n.items() if k.startswith("born_in_")) == len(want)


DIR = "/root/testdata/sf0.001"


def as_slow(df):
    return [(r.ts_ns, str(r.event_id), r.zone_id, r.kind, r.duration_s, r.gender, r.age_code) for r in df.collect()]


def same_as_slow(d, zones, c=StitchConfig()):
    """Trajectories, dropped detections and counters of ``d`` are those of the rules; returns the counters."""
    want, lost = slow_pass1(as_slow(d), zones)
    found, missed, counters = stitch.parts(stitch.tagged(d, zones, c))
    got = {(r.id, r.gender, r.age_code, r.end_ns, tuple((v.zone, v.entry_ns, v.exit_ns, v.dwell_s) for v in r.visits)) for r in found.collect()}
    assert got == want and {(str(r.event_id), r.why) for r in missed.collect()} == lost
    n = {r.counter: r.n for r in counters.collect()}
    for why in ("kind", "zone", "linger", "exit"):
        assert n.get(f"dropped_{why}", 0) == sum(x[1] == why for x in lost)
    assert n["born_at_entrance"] + n["born_inside"] == len(want)
    assert n["matched_in_zone"] + n["matched_after_exit"] + len(want) == sum(len(p[4]) for p in want)
    return n


@pytest.mark.parametrize("most", [200_000, 60])
def test_registered_walks_by_the_rules(spark, most):
    """The demonstration walks: in one piece and with every island cut into epochs of some 60 detections."""
    d = readers.walks(spark, DIR)
    c = StitchConfig(most_at_once=most)
    n = same_as_slow(d, STORE_ZONES, c)
    assert 2 * n["matched_linger"] > n["events_linger"] and 2 * n["matched_exit"] > n["events_exit"] and n["max_live"] > 15
    assert n["refused_gender"] > 5 and n["refused_age"] > 100
    epochs = stitch.in_epochs(d, c).where("gender is not null").agg(F.max("last")).first()[0]
    assert epochs == 0 if most > 1000 else epochs > 5


def test_epochs_of_a_crowd(spark):
    rng, rows = random.Random(4), []
    for i in range(700):
        rows.append((i, rng.randrange(0, 2500) * SECOND, rng.choice(ZONES), rng.choice(["entry", "entry", "linger", "exit"]), rng.choice([None, 5]), rng.choice(["F", "F", "F", None]), rng.randrange(3), "adult"))
    d = spark.createDataFrame(rows, "event_id long, ts_ns long, zone_id string, kind string, duration_s long, gender string, age_code int, age_range string")
    same_as_slow(d, DEMO_ZONES, StitchConfig(most_at_once=40))


def test_whole_run_on_the_walks(spark):
    out = journey.run(spark, readers.walks(spark, DIR), STORE_ZONES)
    n = {r.counter: r.n for r in out["telemetry"].collect()}
    assert out["journeys"].count() > 200 and all(n[f"merged_{s}"] > 0 for s in "abde")
    persons = out["trajectories"].count()
    assert n["persons"] == persons == n["fragments"] - sum(n[f"merged_{s}"] for s in "abcde")
    assert n["dropped"] == sum(v for k, v in n.items() if k.startswith("dropped_")) and 0 < n["recovered"] < n["dropped"]
    for r in out["trajectories"].select("frag_id", "age_code", "visits").collect():
        ages = [v.age for v in r.visits]
        r_mode = max(ages, key=lambda a: (ages.count(a), -ages.index(a)))
        n["corrected_age"] -= AGE_CODES[r_mode] != r.age_code
    assert n["corrected_age"] == 0
    ids = sorted(r.person_id for r in out["journeys"].select("person_id").distinct().collect())
    assert ids[0] == "P_000001" and int(ids[-1][2:]) <= n["fragments"]


def test_dense_numbers(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(-5, 400) * 7_000_000_000, "x") for i in range(500)]
    d = spark.createDataFrame(rows, "id long, at long, other string").repartition(5)
    got = {r.id: r.nth for r in dense_numbers(d, "at", "id", "nth").collect()}
    assert got == {i: k + 1 for k, (i, _, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert dense_numbers(d.limit(0), "at", "id", "nth").count() == 0


def frags(spark, *rows):
    names = "frag_id long, start_us long, end_us long, birth_zone string, last_zone string, n_visits long, gender string, age_code int, born_at_entrance boolean, is_complete boolean"
    return spark.createDataFrame([(i, s * 10**6, e * 10**6, b, l, n, g, a, b.startswith("Z_E"), False) for i, s, e, b, l, n, g, a in rows], names)


@pytest.mark.parametrize("stage, start, n", [("A", 599, 1), ("A", 600, 0), ("B", 240, 1), ("B", 241, 0)])
def test_healing_windows(spark, stage, start, n):
    f = frags(spark, (1, -9, 0, "Z_N1", "Z_N1", 1, "F", 3), (2, start, start + 5, "Z_N1", "Z_N1", 1, "F", 3))
    assert heal.candidates(f, stage).count() == n


@pytest.mark.parametrize("start, n", [(7199, 1), (7200, 0)])
def test_stage_d_ignores_age(spark, start, n):
    f = frags(spark, (1, -9, 0, "Z_E1", "Z_N1", 1, "F", 0), (2, start, start + 5, "Z_S2", "Z_S2", 1, "F", 5))
    assert heal.candidates(f, "D").count() == n


@pytest.mark.parametrize("visits, n", [(1, 0), (2, 1)])
def test_stage_e_wants_two_visits(spark, visits, n):
    f = frags(spark, (1, -9, 0, "Z_N1", "Z_S1", visits, "F", 3), (2, 700, 705, "Z_S1", "Z_S1", 1, "F", 3))
    assert heal.candidates(f, "E").count() == n


def test_fixpoint_merges_a_chain(spark):
    f = frags(spark, *[(i, 100 * i, 100 * i + 50, "Z_N1", "Z_N1", 1, "F", 3) for i in range(5)])
    healed, merged = heal.heal(f, None)
    row = healed.collect()
    assert len(row) == 1 and row[0].frag_id == 0 and row[0].n_visits == 5 and sum(merged.values()) == 4


@pytest.mark.parametrize("stage", "ABCDE")
def test_nearest_edges_are_the_mutual_best_pairs(spark, stage):
    rng = random.Random(ord(stage))
    zones, rows = ["Z_E1", "Z_N1", "Z_S1", "Z_C1", "Z_CK", "Z_E2"], []
    for i in range(400):
        start = rng.randrange(0, 20_000, 5)
        rows.append((i, start, start + rng.randrange(0, 600, 5), rng.choice(zones), rng.choice(zones), rng.randrange(1, 4), rng.choice("FM"), rng.randrange(6)))
    f, edges = frags(spark, *rows), readers.zone_edges(spark, DEMO_ZONES)
    got = {tuple(r)[:3] for r in heal.nearest_edges(f, stage, edges).collect()}
    assert got == {tuple(r)[:3] for r in heal.mutual_best(heal.candidates(f, stage, edges)).collect()} and len(got) > 5
    plain = {tuple(r)[:3] for r in heal.nearest_edges(f, stage).collect()}
    assert plain == {tuple(r)[:3] for r in heal.mutual_best(heal.candidates(f, stage)).collect()}


ZONES = ["Z_E1", "Z_N1", "Z_S1", "Z_C1", "Z_CK", "Z_E2"]


def crowd(seed, n=400, span=20_000):
    """Random fragments: (id, start, end, first zone, last zone, visits, gender, age), times in seconds."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        start = rng.randrange(0, span, 5)
        rows.append((i, start, start + rng.randrange(0, 600, 5), rng.choice(ZONES), rng.choice(ZONES), rng.randrange(1, 4), rng.choice("FM"), rng.randrange(6)))
    return rows


def in_sequence(rows, stage, near):
    """One stage as the published method does it: heads one after another, merged as they choose."""
    exits, checkouts = ("Z_E1", "Z_E2", "Z_CK"), ("Z_C1", "Z_C2", "Z_C3", "Z_CK")
    window = {"A": 600, "B": 240, "C": 600, "D": 7200, "E": 7200}[stage]
    people = [dict(zip(("id", "start", "end", "birth", "last", "n", "gender", "age", "complete"), (*r[:8], len(r) > 8 and r[8]))) for r in rows]
    people.sort(key=lambda p: (p["start"], p["id"]))

    def orphan(p):
        return p["birth"] in ("Z_E1", "Z_E2") and not p["complete"] and p["last"] not in exits

    heads = [p for p in people if p["last"] not in exits and (stage in "AB" or orphan(p) or (stage == "E" and p["n"] >= 2))]
    if stage in "CD":
        heads.sort(key=lambda p: (p["end"], p["id"]))
    tails = [p for p in people if stage != "C" or (p["last"] in checkouts and not p["complete"] and not orphan(p))]
    gone, edges = set(), set()
    for a in heads:
        if a["id"] in gone:
            continue
        best, most = None, -1.0
        for b in tails:
            gap = b["start"] - a["end"]
            step = abs(a["age"] - b["age"])
            if b["id"] in gone or b is a or b["gender"] != a["gender"] or not 0 < gap <= window or (gap == window and stage != "B"):
                continue
            close = (a["last"], b["birth"]) in near
            if stage in "ABC" and (step > 1 or not (close or a["last"] == b["birth"])) or stage == "E" and a["last"] != b["birth"]:
                continue
            person = 0.5 + 0.5 * max(0.0, 1 - step / 2)
            time = 1.0 - gap / window
            score = {"A": (2.0 if a["last"] == b["birth"] else 1.0) + 0.5 * time + 0.3 * person, "C": 0.6 * person + 0.4 * time, "D": 0.5 * person + 0.5 * time}.get(stage, time)
            if score > most:
                best, most = b, score
        if best is not None:
            gone.add(best["id"])
            edges.add((a["id"], best["id"]))
    return edges


@pytest.mark.parametrize("stage, seed", [("A", 2), *[(s, 1) for s in "ABCDE"]])
def test_reference_order_is_the_sequence(spark, stage, seed):
    rows = crowd(seed, 400 if seed == 1 else 250, 20_000 if seed == 1 else 4_000)
    near = {(a, b) for x, y, _ in DEMO_ZONES.edges for a, b in ((x, y), (y, x))}
    want = in_sequence(rows, stage, near)
    f, edges = frags(spark, *rows), readers.zone_edges(spark, DEMO_ZONES)
    got = {tuple(r)[:2] for r in heal.greedy_edges(f, stage, edges).collect()}
    assert got == want and len(want) > 5
    mutual = {tuple(r)[:2] for r in heal.nearest_edges(f, stage, edges).collect()}
    assert mutual != want or stage == "C"


def healed_in_sequence(rows, near, passes=15):
    people = [list(r[:8]) + [False] for r in rows]
    for _ in range(passes):
        merged = 0
        for stage in "ABCDE":
            edges = dict(in_sequence(people, stage, near))
            by, inner = {p[0]: p for p in people}, set(edges.values())
            people = []
            for p in by.values():
                if p[0] in inner:
                    continue
                q, at = list(p), p[0]
                while at in edges:
                    at = edges[at]
                    q[2], q[4], q[5] = by[at][2], by[at][4], min(q[5] + by[at][5], 50)
                q[8] = q[8] or (q[3] in ("Z_E1", "Z_E2") and q[4] in ("Z_E1", "Z_E2", "Z_CK"))
                people.append(q)
            merged += len(edges)
        if not merged:
            break
    return {tuple(p[:6]) for p in people}


def test_whole_healing_in_reference_order(spark):
    rows = crowd(5, 120, 9_000)
    near = {(a, b) for x, y, _ in DEMO_ZONES.edges for a, b in ((x, y), (y, x))}
    f = frags(spark, *rows)
    healed, merged = heal.heal(f, readers.zone_edges(spark, DEMO_ZONES), order="reference")
    got = {(r.frag_id, r.start_us // 10**6, r.end_us // 10**6, r.birth_zone, r.last_zone, r.n_visits) for r in healed.collect()}
    assert got == healed_in_sequence(rows, near) and sum(merged.values()) == len(rows) - len(got) > 20


def test_merge_joins_visits(spark):
    visit = "struct<zone:string,entry_ns:bigint,exit_ns:bigint,dwell_s:bigint,age:string,ghost:boolean>"
    f = frags(spark, (1, 0, 10, "Z_E1", "Z_N1", 2, "F", 3), (2, 20, 30, "Z_S1", "Z_CK", 1, "F", 3), (3, 90, 95, "Z_N1", "Z_N1", 1, "F", 3))
    visits = {1: [("Z_E1", 0, 5, 0, "adult", False), ("Z_N1", 6, None, 0, "adult", False)], 2: [("Z_S1", 20, 30, 9, "adult", False)], 3: [("Z_N1", 90, None, 0, "adult", False)]}
    v = spark.createDataFrame(list(visits.items()), f"frag_id long, visits array<{visit}>")
    edges = spark.createDataFrame([(1, 2)], "head_id long, tail_id long")
    got = {r.frag_id: r for r in heal.merge(f.join(v, "frag_id"), edges).collect()}
    assert set(got) == {1, 3} and got[1].is_complete and got[1].n_visits == 3 and got[1].end_us == 30 * 10**6
    assert [tuple(x) for x in got[1].visits] == [visits[1][0], ("Z_N1", 6, 19, 0, "adult", True), visits[2][0]]
    assert [tuple(x) for x in got[3].visits] == visits[3]


def test_whole_run_merges_fragments(spark):
    """Two persons whose sightings break off for five minutes, and one alone."""
    rows, at = [], 0
    for p, (start, gender) in enumerate([(0, "F"), (5000, "M"), (9000, "F")]):
        steps = [("Z_E1", "entry", 0), ("Z_E1", "exit", 20), ("Z_N1", "entry", 25), ("Z_N1", "exit", 60), ("Z_N1", "entry", 360), ("Z_N1", "linger", 370), ("Z_S1", "entry", 400)]
        for zone, kind, later in steps[: 7 if p < 2 else 4]:
            rows.append((at, (start + later) * SECOND, zone, kind, 30, gender, 3, "adult"))
            at += 1
    d = spark.createDataFrame(rows, "event_id long, ts_ns long, zone_id string, kind string, duration_s long, gender string, age_code int, age_range string")
    out = journey.run(spark, d, DEMO_ZONES)
    got = sorted((r.start_us // 10**6, r.n_visits, len(r.visits)) for r in out["trajectories"].collect())
    assert got == [(0, 4, 4), (5000, 4, 4), (9000, 2, 2)]
    assert out["journeys"].count() == 8 and out["journeys"].where("is_ghost_exit").count() == 2
    counters = {r.counter: r.n for r in out["telemetry"].collect()}
    assert sum(n for k, n in counters.items() if k.startswith("merged_")) == 2


def test_registered_healing_has_no_limit_of_its_own(spark, monkeypatch):
    from trailweave.plans import journey, registry

    asked = []
    monkeypatch.setattr(registry.heal, "heal", lambda f, e, c=StitchConfig(): (asked.append(c), (f, {}))[1])
    monkeypatch.setattr(journey, "run", lambda s, d, z, c=StitchConfig(): (asked.append(c), {"journeys": None})[1])
    for name in ("fragments", "walks"):
        monkeypatch.setattr(registry.rd, name, lambda *a: frags(spark, (1, 0, 1, "Z_N1", "Z_N1", 1, "F", 3)))
    registry.QUERIES["heal_fixpoint"](spark, "")
    registry.QUERIES["stitch_full"](spark, "")
    assert asked == [StitchConfig()] * 2


def test_teleport_needs_the_same_bin(spark):
    f = frags(spark, (1, 580, 590, "Z_N1", "Z_N1", 1, "F", 3))
    d = spark.createDataFrame([(1, 595 * 10**6, "Z_S1", "M"), (2, 610 * 10**6, "Z_S1", "M")], "event_id long, entry_us long, zone_id string, gender string")
    assert [r.event_id for r in sweep.teleport(d, f).collect()] == [1]


def test_purity_takes_the_first_seen_of_equals(spark):
    v = spark.createDataFrame([("p", i, a) for i, a in enumerate(["adult", "senior", "senior", "adult"])], "person_id string, pos int, age string")
    assert sweep.mode_first_seen(v, "person_id", "age", ["pos"]).first().age == "adult"


def test_results_do_not_depend_on_partitions(spark):
    rows = [(i, i * 7 * SECOND, ["Z_E1", "Z_N1", "Z_S1", "Z_C1"][i * 7 % 4], ["entry", "linger", "exit"][i * 5 % 3], 1, ["F", "M", None][i % 3], i % 6, "adult") for i in range(300)]
    d = spark.createDataFrame(rows, "event_id long, ts_ns long, zone_id string, kind string, duration_s long, gender string, age_code int, age_range string")
    one = stitch.stitch(d.coalesce(1), DEMO_ZONES).drop("visits")
    many = stitch.stitch(d.repartition(7, F.rand(1)), DEMO_ZONES).drop("visits")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert stitch.stitch(d.limit(0), DEMO_ZONES).count() == 0


def test_walks():
    assert graph.min_walk(G, "Z_E1", "Z_CK") == 45 and graph.min_walk(G, "Z_S2", "Z_S2") == 0
    with pytest.raises(KeyError):
        graph.min_walk(G, "Z_E1", "Z_X")
