"""Steps that must not grow faster than their input: the same results as the plain forms, without tables of pairs."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from test_stitch import crowd, frags, in_sequence
from trailweave.operators import heal, sweep
from trailweave.operators.temporal import near
from trailweave.schema import DEMO_ZONES
from trailweave.sources import readers

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="demonstration tables are absent")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_teleport_ignores_a_trajectory_that_ends_before_it_starts(spark):
    d = spark.createDataFrame([(1, 1_000_000_000, "Z_N1", "F")], "event_id long, entry_us long, zone_id string, gender string")
    f = spark.createDataFrame([(3_000_000_000, 1_000_000_000)], "start_us long, end_us long")
    assert sweep.teleport(d, f).count() == 0 and sweep.teleport(d, f, how="left_anti").count() == 1


def test_teleport_looks_at_a_trajectorys_last_bins_alone(spark):
    """A trajectory of a year has 52,560 bins; only its last two can hold a moment near its end."""
    year = 365 * 86_400 * 10**6
    d = spark.createDataFrame([(i, year + i * 60_000_000, "Z_N1", "F") for i in range(-20, 20)], "event_id long, entry_us long, zone_id string, gender string")
    f = spark.createDataFrame([(i, year + i) for i in range(5)], "start_us long, end_us long")
    assert {r.event_id for r in sweep.teleport(d, f).collect()} == {-2, -1, 0, 1, 2}
    seen = []
    sweep_near = sweep.near
    try:
        sweep.near = lambda left, right, *rest: seen.append(right.count()) or sweep_near(left, right, *rest)
        sweep.teleport(d, f)
    finally:
        sweep.near = sweep_near
    assert seen == [10]


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_near_is_the_plain_search_and_meets_one_row(spark, how):
    rng = random.Random(3)
    left = [(i, rng.choice("ab"), rng.randrange(-900, 3000)) for i in range(300)] + [(300, None, 5), (301, "a", None)]
    right = [(rng.choice("ab"), rng.randrange(-900, 3000, 7)) for _ in range(60)] + [("b", None), (None, 5)]
    l, r = spark.createDataFrame(left, "id long, k string, at long"), spark.createDataFrame(right, "k string, t long")
    hit = {i for i, k, at in left if k is not None and at is not None and any(k == k2 and t is not None and abs(at - t) <= 20 for k2, t in right)}
    got = near(l, r, ["k"], "at", "t", 20, how)
    assert {x.id for x in got.collect()} == (hit if how == "left_semi" else {x[0] for x in left} - hit) and got.columns == l.columns
    assert "Aggregate" in plan(got)


@pytest.mark.parametrize("stage", "ABCDE")
def test_nearest_tails_are_the_best_of_all_pairs(spark, stage):
    rows = crowd(ord(stage) + 5)
    rows += [(1000 + r[0], *r[1:]) for r in rows[:150]]  # copies at the same moments
    f, edges = frags(spark, *rows), readers.zone_edges(spark, DEMO_ZONES)
    for e in (edges, None):
        want = {(r.head_id, r.tail_id, r.gap_us, r.n_candidates) for r in heal.best_tail(heal.candidates(f, stage, e)).collect()}
        got = heal.nearest_tails(f, stage, e)
        assert {(r.head_id, r.tail_id, r.gap_us, r.n_candidates) for r in got.collect()} == want and len(want) > 5
        assert "Join Inner" not in plan(got).replace("Join Inner, (last_zone", "")


@tables
@pytest.mark.parametrize("name", [*[f"heal_{x}_candidates" for x in "abcde"], "mutual_best_edges"])
def test_no_table_of_pairs(spark, name):
    assert "b_start_us" not in plan(entry.queries()[name](spark, DIR))


def test_birth_numbers_of_seven_digits_are_cut_as_in_sql(spark, monkeypatch):
    from trailweave.plans import registry

    def far(df, at, key, name):
        return df.withColumn(name, F.lit(1_234_567))

    monkeypatch.setattr(registry, "dense_numbers", far)
    if os.path.isdir(DIR):
        assert registry.birth_numbers(spark, DIR).first().person == "P_123456"


@pytest.mark.parametrize("stage", "ABCDE")
def test_nearest_edges_over_many_slices(spark, monkeypatch, stage):
    """Without windows, whose rows are a fragment's zones by ages by buckets; the same edges for short slices and copies."""
    monkeypatch.setattr(heal, "SLICE", 1)
    rows = crowd(ord(stage) + 5)
    rows += [(1000 + r[0], *r[1:]) for r in rows[:150]]
    f, edges = frags(spark, *rows), readers.zone_edges(spark, DEMO_ZONES)
    want = {tuple(r) for r in heal.mutual_best(heal.candidates(f, stage, edges)).collect()}
    got = heal.nearest_edges(f, stage, edges)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 2 and "Window" not in plan(got)


@pytest.mark.parametrize("few", [0, 100_000])
def test_fragments_on_no_edge_are_not_grouped(spark, monkeypatch, few):
    monkeypatch.setattr(heal, "FEW_EDGES", few)
    f, c = frags(spark, *crowd(3)).select(*heal.COLUMNS), heal.StitchConfig()
    found = heal.settle(heal.nearest_edges(f, "E"))
    got = heal._after(f, found, found.count(), c)
    assert sorted(map(tuple, got.select(*heal.COLUMNS).collect())) == sorted(map(tuple, heal.merge(f, found, c).select(*heal.COLUMNS).collect()))
    assert "LeftAnti" in plan(got)


def test_sequence_by_end_makes_no_table_of_pairs(spark, monkeypatch):
    """Copies at the same moments compete for the same tails, over several buckets."""
    rows = crowd(11, 300, 40_000)
    rows += [(1000 * k + r[0], *r[1:]) for k in (1, 2, 3) for r in rows[:100]]
    f, edges = frags(spark, *rows), readers.zone_edges(spark, DEMO_ZONES)
    monkeypatch.setattr(heal, "candidates", None)
    near = {(a, b) for x, y, _ in DEMO_ZONES.edges for a, b in ((x, y), (y, x))}
    for stage in "CD":
        got = {tuple(r)[:2] for r in heal.greedy_edges(f, stage, edges).collect()}
        assert got == in_sequence(rows, stage, near) and len(got) > 5


@tables
def test_streams_join_on_time_buckets(spark):
    from trailweave.streaming import windows

    v = readers.visits(spark, DIR).withColumn("ts", F.timestamp_micros("entry_us")).withColumn("visit_id", F.col("event_id"))
    assert "e_bin" in plan(windows.covered(v, v.select("event_id", "zone_id", "ts", F.col("entry_us").alias("at_us"))))
    f = readers.fragments(spark, DIR).withColumn("ts", F.timestamp_micros("end_us"))
    d = readers.detections(spark, DIR).withColumn("ts", F.timestamp_micros("entry_us"))
    assert "t_bin" in plan(windows.recovered(d, f, readers.zone_edges(spark, DEMO_ZONES)))


def test_waiting_detections_are_parts_of_a_minute():
    from trailweave.streaming.stitch import WAITING_KEY

    assert WAITING_KEY.split()[0] == "minute"


def test_levels_of_documents_are_opened_once(spark, monkeypatch):
    from trailweave.functions import text

    seen = []
    monkeypatch.setattr(text, "settle", lambda df: seen.append(1) or df)
    docs = spark.createDataFrame([(1, '{"a": [1, {"b": "2 of 3"}], "c": 4.5}')], "id long, doc string")
    assert sorted(r.number for r in text.flat_numbers(docs, "doc").collect()) == [1.0, 2.0, 3.0, 4.5] and len(seen) == 4
