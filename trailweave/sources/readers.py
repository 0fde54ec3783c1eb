"""Readers and writers of the engine's own formats, and adapters of the demonstration tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailweave.functions.scalar import completed, is_entrance, micros
from trailweave.schema import AGE_CODES, EVENTS, JOURNEYS, REQUIRED, Zones


def read_events(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """Typed detections; columns that a query leaves out are not read from parquet."""
    reader = spark.read.schema(EVENTS)
    return reader.csv(path, header=True) if form == "csv" else spark.read.format(form).load(path)


def read_journeys(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """Journeys with their required columns present and numbers coerced: what is no number becomes null."""
    if form == "csv":
        df = spark.read.csv(path, header=True, inferSchema=False)
    else:
        df = spark.read.format(form).load(path)
    return coerce_journeys(df)


def coerce_journeys(df: DataFrame) -> DataFrame:
    if missing := sorted(set(REQUIRED) - set(df.columns)):
        raise ValueError(f"journeys lack the columns {missing}")
    known = {f.name: f.dataType for f in JOURNEYS}
    return df.select(*[F.col(c).try_cast(known[c]).alias(c) if c in known else F.col(c) for c in df.columns])


def write_journeys(trajectories: DataFrame, path: str, form: str = "parquet") -> None:
    journeys(trajectories).write.mode("overwrite").partitionBy("visit_date").format(form).save(path)


def journeys(trajectories: DataFrame) -> DataFrame:
    """One row for each closed visit; visits still open at the end are left out."""
    v = trajectories.select("*", F.explode("visits").alias("v")).where("v.exit_ns is not null")

    def moment(ns: Column) -> Column:
        return F.timestamp_micros(F.call_function("div", ns, F.lit(1000).cast("long"))).cast("timestamp_ntz")

    entry = moment(F.col("v.entry_ns"))
    return v.select(
        F.col("id").alias("person_id"),
        F.col("v.zone").alias("zone_id"),
        entry.alias("entry_time"),
        moment(F.col("v.exit_ns")).alias("exit_time"),
        F.coalesce(F.col("v.dwell_s"), F.lit(0)).cast("double").alias("dwell_s"),
        "gender",
        F.col("v.age").alias("age_range"),
        F.to_date(entry).alias("visit_date"),
        F.hour(entry).alias("hour_of_day"),
        F.col("v.ghost").alias("is_ghost_exit"),
        "born_at_entrance",
        (~F.col("born_at_entrance")).alias("is_fragment"),
        "is_complete",
    )


ZONES_JSON = T.StructType([T.StructField("zones", T.MapType(T.StringType(), T.StructType([T.StructField("walk_seconds", T.MapType(T.StringType(), T.IntegerType()))])))])


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Undirected edges (a, b, walk_s), each in both directions."""
    raw = spark.read.schema(ZONES_JSON).json(path, multiLine=True)
    out = raw.select(F.explode("zones").alias("a", "z")).select("a", F.explode("z.walk_seconds").alias("b", "walk_s"))
    return out.union(out.select("b", "a", "walk_s")).distinct()


def zone_edges(spark: SparkSession, zones: Zones) -> DataFrame:
    both = [e for a, b, w in zones.edges for e in ((a, b, w), (b, a, w))]
    return spark.createDataFrame(both, "a string, b string, walk_s int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ZONE_OF = {"signup": "Z_E1", "purchase": "Z_CK", "view": "Z_N1", "click": "Z_S1", "error": "Z_C1"}
SESSION_GAP_US = 8 * 3600 * 1_000_000


def _zone() -> Column:
    zone = F.lit(None).cast("string")
    for kind, name in ZONE_OF.items():
        zone = F.when(F.col("event_type") == kind, name).otherwise(zone)
    return zone


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as visits: users are persons, event types zones, values seconds of stay."""
    return visits_of(table(spark, sf_dir, "events"))


def visits_of(events: DataFrame) -> DataFrame:
    at = micros(F.col("ts"))
    return events.select(
        "event_id",
        F.col("user_id").alias("person_id"),
        _zone().alias("zone_id"),
        at.alias("entry_us"),
        (at + F.floor(F.col("value") * 1000000).cast("long")).alias("exit_us"),
        F.col("value").alias("dwell_s"),
        F.when(F.col("user_id") % 2 == 0, "F").otherwise("M").alias("gender"),
        (F.col("user_id") % 6).cast("int").alias("age_code"),
        F.to_date("ts").alias("visit_date"),
        F.hour("ts").alias("hour_of_day"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as anonymous detections of the three kinds."""
    return detections_of(visits(spark, sf_dir))


def detections_of(v: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(F.lit("entry"), F.lit("linger"), F.lit("exit")), (F.col("event_id") % 3 + 1).cast("int"))
    labels = F.array(*[F.lit(x) for x in AGE_CODES])
    return v.select(
        "event_id",
        "entry_us",
        (F.col("entry_us") * 1000).alias("ts_ns"),
        "zone_id",
        kind.alias("kind"),
        F.floor("dwell_s").cast("long").alias("duration_s"),
        "gender",
        "age_code",
        F.element_at(labels, F.col("age_code") + 1).alias("age_range"),
    )


#: A demonstration walk: 16 detections in five zones. Kind, place in the order of zones, and seconds since its start.
WALK = (
    ("entry", 1, 0), ("linger", 1, 4), ("exit", 1, 6), ("entry", 2, 12), ("linger", 2, 16), ("exit", 2, 19),
    ("entry", 3, 30), ("linger", 3, 36), ("linger", 3, 42), ("exit", 3, 46), ("entry", 4, 56), ("linger", 4, 60),
    ("exit", 4, 63), ("entry", 5, 70), ("linger", 5, 74), ("exit", 5, 77),
)
#: Ways of walking: the zones, the step from which on sensors saw the person late, and by how many seconds.
WAYS = (
    (("Z_E1", "Z_N1", "Z_S1", "Z_C1", "Z_CK"), 16, 0),
    (("Z_E2", "Z_N2", "Z_S4", "Z_C2", "Z_CK"), 6, 300),
    (("Z_E1", "Z_N1", "Z_S2", "Z_N1", "Z_E1"), 5, 215),
    (("Z_E2", "Z_N2", "Z_S5", "Z_C3", "Z_CK"), 10, 1500),
    (("Z_N1", "Z_S3", "Z_S3", "Z_C2", "Z_CK"), 6, 1500),
    (("Z_E2", "Z_N2", "Z_S6", "Z_C3", "Z_CK"), 10, 420),
    (("Z_E1", "Z_N1", "Z_S1", "Z_C1", "Z_CK"), 10, 400),
)
WALK_BEGINS_US, WALK_EVERY_US = 1_704_099_600_000_000, 2_200_000


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks_of(table(spark, sf_dir, "events"))


def walks_of(events: DataFrame) -> DataFrame:
    """The event table as a busy store's detections, row by row: 16 neighbouring events are one person's walk, a
    new one begins every 2.2 seconds, and some walks break off for minutes. Users add up to two seconds to a
    time and values are stays. Now and then a sensor misreads an age, a gender, a kind or a zone."""
    walker, step = F.floor(F.col("event_id") / 16), (F.col("event_id") % 16).cast("int")
    way = (walker % len(WAYS)).cast("int")

    def pick(values: list, at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in values]), at + 1)

    zones = F.element_at(F.array(*[F.array(*[F.lit(z) for z in names]) for names, _, _ in WAYS]), way + 1)
    late = F.when(step >= pick([x for _, x, _ in WAYS], way), pick([x for _, _, x in WAYS], way)).otherwise(0)
    seconds = pick([x for _, _, x in WALK], step) + late + F.col("user_id") % 3
    group = walker % 6  # two genders and three ages, neighbours apart, so that a crowd can be told apart
    age = (F.floor(group / 2) * 2 + F.when(F.col("event_id") % 13 == 0, 1).otherwise(0)).cast("int")
    e = events.select(
        "event_id",
        (F.lit(WALK_BEGINS_US) + walker * WALK_EVERY_US + seconds * 1_000_000).cast("long").alias("entry_us"),
        F.when(F.col("event_id") % 103 == 0, "Z_X9").otherwise(F.element_at(zones, pick([x for _, x, _ in WALK], step))).alias("zone_id"),
        F.when(F.col("event_id") % 101 == 0, "blink").otherwise(pick([x for x, _, _ in WALK], step)).alias("kind"),
        F.floor("value").cast("long").alias("duration_s"),
        F.when(F.col("event_id") % 97 == 0, F.lit(None)).when(group % 2 == 0, "F").otherwise("M").alias("gender"),
        F.least(age, F.lit(5)).alias("age_code"),
    )
    labels = F.array(*[F.lit(x) for x in AGE_CODES])
    return e.select("event_id", "entry_us", (F.col("entry_us") * 1000).alias("ts_ns"), "zone_id", "kind", "duration_s", "gender", "age_code", F.element_at(labels, F.col("age_code") + 1).alias("age_range"))


def noisy_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits whose gender and age are misread now and then."""
    other = F.when(F.col("gender") == "F", "M").otherwise("F")
    v = visits(spark, sf_dir).withColumn("gender", F.when(F.col("event_id") % 3 == 0, other).otherwise(F.col("gender")))
    return v.withColumn("age_code", F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 6).cast("int")).otherwise(F.col("age_code")))


def planted_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits with anomalies put in: the last day has crowded evenings and empty early hours, and a zone of long
    stays takes every 200th visit."""
    v = visits(spark, sf_dir)
    v = v.join(F.broadcast(v.agg(F.max("visit_date").alias("last_day"))))  # one row
    today, hour = F.col("visit_date") == F.col("last_day"), F.col("hour_of_day")
    v = v.where(~(today & (hour < 6) & (F.col("person_id") % 10 > 0)))
    copies = F.when(today & (hour >= 20), F.sequence(F.lit(0), F.lit(9))).otherwise(F.array(F.lit(0)))
    v = v.withColumn("k", F.explode(copies)).withColumn("person_id", F.col("person_id") + F.col("k") * 100_000)
    long = F.col("event_id") % 200 == 0
    v = v.withColumn("zone_id", F.when(long, "Z_S9").otherwise(F.col("zone_id"))).withColumn("dwell_s", F.when(long, F.col("dwell_s") * 50).otherwise(F.col("dwell_s")))
    return v.drop("k", "last_day")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as insight items: doc, item, strategy, category, title and text, which makes a claim."""
    word = F.element_at(F.array(*[F.lit(x) for x in ("Traffic", "Funil", "zona", "Anomaly", "other", "resumo")]), (F.col("turn") % 6 + 1).cast("int"))
    title = F.element_at(F.array(*[F.lit(x) for x in ("Peak hour", "Conversão por hora", "dwell", "Note")]), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    claim = F.concat(F.col("text"), F.lit(" In all "), (F.col("conv_id") % 50 + F.col("turn")).cast("string"), F.lit(" of 1,000."))
    strategy = F.when((F.col("turn") + F.col("conv_id")) % 2 == 0, "zero_shot").otherwise("few_shot")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("item"), strategy.alias("strategy"), word.alias("category"), title.alias("title"), claim.alias("text")
    )


def visit_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments with their visits as an array in order; every fourth visit has no end."""
    w = Window.partitionBy("person_id").orderBy("entry_us", "event_id")
    v = _sessions(spark, sf_dir)
    v = v.withColumn("frag_id", F.first("event_id").over(Window.partitionBy("person_id", "session").orderBy("entry_us", "event_id")))
    end = F.when(F.col("event_id") % 4 != 0, F.col("exit_us") * 1000)
    visit = F.struct(
        F.row_number().over(w).alias("nth"), F.col("zone_id").alias("zone"), (F.col("entry_us") * 1000).alias("entry_ns"), end.alias("exit_ns"), F.lit(False).alias("ghost")
    )
    arrays = v.select("frag_id", visit.alias("v")).groupBy("frag_id").agg(F.transform(F.sort_array(F.collect_list("v")), lambda x: x.dropFields("nth")).alias("visits"))
    return fragments(spark, sf_dir).join(arrays, "frag_id")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("person_id").orderBy("entry_us", "event_id")
    v = visits(spark, sf_dir).withColumn("away", F.col("entry_us") - F.lag("entry_us").over(w))
    return v.withColumn("session", F.sum(F.when(F.col("away").isNull() | (F.col("away") >= SESSION_GAP_US), 1).otherwise(0)).over(w))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of visits, cut where a person is away for eight hours, as trajectory fragments."""
    v = _sessions(spark, sf_dir)
    order = F.struct("entry_us", "event_id")
    out = v.groupBy("person_id", "session").agg(
        F.min_by("event_id", order).alias("frag_id"),
        F.min("entry_us").alias("start_us"),
        F.max_by("exit_us", order).alias("end_us"),
        F.min_by("zone_id", order).alias("birth_zone"),
        F.max_by("zone_id", order).alias("last_zone"),
        F.count("*").alias("n_visits"),
        F.first("gender").alias("gender"),
        F.first("age_code").alias("age_code"),
    )
    return out.withColumn("born_at_entrance", is_entrance(F.col("birth_zone"))).withColumn(
        "is_complete", completed(F.col("birth_zone"), F.col("last_zone"))
    )


def labels_of_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits with an age label, some of them unknown."""
    labels = F.array(*[F.lit(x) for x in AGE_CODES], F.lit("unheard_of"))
    return visits(spark, sf_dir).select("event_id", F.element_at(labels, (F.col("person_id") % 7 + 1).cast("int")).alias("age_range"))


