import os

import pytest
from pyspark.sql import functions as F

from trailweave.operators import audit, stitch, sweep
from trailweave.schema import DEMO_ZONES, STORE_ZONES
from trailweave.sources import readers
from trailweave.streaming import windows
from trailweave.streaming.common import EVENTS, run_to_end
from trailweave.streaming.stitch import run_files

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="demonstration tables are absent")


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_stream_gives_what_the_batch_gives_after_a_restart(spark, tmp_path):
    """Trajectories and dropped detections, those of the last minutes included; the files come in two halves, with a
    restart from the checkpoint between them."""
    events, source = spark.read.parquet(f"{DIR}/events.parquet"), str(tmp_path / "in")
    d = readers.walks_of(events)
    half = d.agg(F.median("entry_us").cast("long")).first()[0]
    early = d.where(F.col("entry_us") < half).select("event_id")
    events.join(early, "event_id", "left_semi").coalesce(1).write.parquet(source)
    first = run_files(spark, source, str(tmp_path / "out"), STORE_ZONES, close=False)
    batch = stitch.parts(stitch.tagged(d, STORE_ZONES))
    want = {str(tuple(r)) for r in batch[0].drop("visits").collect()}
    assert {str(tuple(r)) for r in stitch.parts(first)[0].drop("visits").collect()} <= want
    events.join(early, "event_id", "left_anti").coalesce(1).write.mode("append").parquet(source)
    stream = stitch.parts(run_files(spark, source, str(tmp_path / "out"), STORE_ZONES))
    for got, want in zip(stream[:2], batch[:2]):
        got, want = rows(got.drop("visits")), rows(want.drop("visits"))
        assert got == want and len(got) > 50
    visits = [rows(x[0].select("id", F.explode("visits").alias("v")).select("id", "v.*")) for x in (stream, batch)]
    assert visits[0] == visits[1] and len(visits[0]) > 200


def test_hourly_traffic_and_sessions(spark, tmp_path):
    v = readers.visits(spark, DIR).withColumn("ts", F.timestamp_micros("entry_us"))
    got = windows.run_events(spark, f"{DIR}/events.parquet*", str(tmp_path / "a"), windows.hourly_traffic, "hour_start timestamp, unique_visitors long, total_visits long")
    want = v.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count_distinct("person_id"), F.count("*"))
    assert rows(got) == rows(want) and got.count() > 100
    got = windows.run_events(spark, f"{DIR}/events.parquet*", str(tmp_path / "b"), windows.sessions, "person_id long, start timestamp, last timestamp, n_visits long")
    want = readers.fragments(spark, DIR).select("person_id", F.timestamp_micros("start_us").alias("start"), "n_visits")
    assert rows(got.select("person_id", "start", "n_visits")) == rows(want)


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    """Three files, one a batch: the third brings a row behind the watermark that the second has moved."""
    source, late = str(tmp_path / "in"), []
    for k, hours in enumerate([(0, 1), (30,), (2, 31)]):
        some = spark.createDataFrame([(k * 10 + h, h) for h in hours], "event_id long, h int")
        ts = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("h"))).cast("timestamp_ntz")
        some.select("event_id", ts.alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).coalesce(1).write.mode("append").parquet(source)

        def build(closing):
            return windows.hourly_traffic(windows.timed(readers.visits_of(spark.readStream.schema(EVENTS).parquet(source).unionByName(closing))))

        got = run_to_end(spark, build, str(tmp_path / "out"), "hour_start timestamp, unique_visitors long, total_visits long", EVENTS, "ts", None, 0, late)
    assert sum(late) == 1 and sorted(r.hour_start.hour for r in got.collect()) == [0, 1]


def test_coverage_over_streams(spark, tmp_path):
    def make(v):
        events = v.select("event_id", "zone_id", "ts", F.col("entry_us").alias("at_us"))
        return windows.covered(v.withColumn("visit_id", F.col("event_id")), events)

    got = windows.run_events(spark, f"{DIR}/events.parquet*", str(tmp_path / "out"), make, "visit_id long, event_id long")
    v = readers.visits(spark, DIR)
    want = audit.coverage(v, v.select("zone_id", F.col("entry_us").alias("ts_us"))).first()
    assert got.count() == want.mapped_events > 1000 and got.distinct().count() == got.count()


def test_residual_over_streams(spark, tmp_path):
    """Dropped detections and trajectory ends, both as streams of files, against the batch rules."""
    d = readers.detections(spark, DIR).where("kind = 'linger'").select("event_id", "entry_us", "zone_id", "gender")
    f = readers.fragments(spark, DIR).select("frag_id", "start_us", "end_us", "last_zone", "gender")
    edges = readers.zone_edges(spark, DEMO_ZONES)
    far, kinds = 9_000_000 * 10**6, {k: ", ".join(f"{n} {t}" for n, t in x.dtypes) for k, x in (("d", d), ("f", f))}
    for name, df in (("d", d), ("f", f)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    end = max(d.agg(F.max("entry_us")).first()[0], f.agg(F.max("end_us")).first()[0]) + far
    closing = {"d": spark.createDataFrame([(None, end, None, None)], kinds["d"]), "f": spark.createDataFrame([(None, end, end, None, None)], kinds["f"])}

    def build(_):
        left = spark.readStream.schema(kinds["d"]).parquet(str(tmp_path / "d")).withColumn("ts", F.timestamp_micros("entry_us"))
        right = spark.readStream.schema(kinds["f"]).parquet(str(tmp_path / "f")).withColumn("ts", F.timestamp_micros("end_us"))
        return windows.recovered(left, right, edges)

    for _ in range(2):
        got = run_to_end(spark, build, str(tmp_path / "out"), "event_id long, rule string", "x long", "x", None, 0)
        for name, df in closing.items():
            df.write.mode("append").parquet(str(tmp_path / name))
    left = got.where("event_id is not null").groupBy("event_id").agg(F.max("rule").alias("rule")).where("rule is null").select("event_id")
    want = sweep.residual(d, f, edges).select("event_id")
    assert rows(left) == rows(want) and len(rows(want)) > 10
