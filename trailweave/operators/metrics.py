"""Traffic, funnel, dwell and anomaly metrics over visits, as aggregate plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions.scalar import is_interior, percent, round_even
from trailweave.schema import CHECKOUT, AnomalyConfig


def traffic_by_hour(v: DataFrame) -> DataFrame:
    return v.where("hour_of_day is not null").groupBy("hour_of_day").agg(
        F.count_distinct("person_id").alias("unique_visitors"), F.count("person_id").alias("total_visits")
    )


def traffic_totals(v: DataFrame) -> DataFrame:
    return v.agg(F.count_distinct("person_id").alias("total_unique_visitors"), F.count("*").alias("total_visits"))


def peak_quiet_hour(v: DataFrame) -> DataFrame:
    """The busiest and the quietest hour; of equals the earliest."""
    h, uv = F.col("hour_of_day"), F.col("unique_visitors")
    return traffic_by_hour(v).agg(
        F.max_by(h, F.struct(uv, -h)).alias("peak_hour"),
        F.max(uv).alias("peak_unique_visitors"),
        F.min_by(h, F.struct(uv, h)).alias("quiet_hour"),
        F.min(uv).alias("quiet_unique_visitors"),
    )


def top_hours(v: DataFrame, n: int = 10) -> DataFrame:
    return traffic_by_hour(v).orderBy(F.desc("unique_visitors"), "hour_of_day").limit(n)


def _funnel() -> list[Column]:
    all_, paid = F.count_distinct("person_id"), F.count_distinct(F.when(F.col("zone_id") == CHECKOUT, F.col("person_id")))
    return [all_.alias("unique_visitors"), paid.alias("reached_checkout"), percent(paid, all_).alias("conversion_rate")]


def funnel_overall(v: DataFrame) -> DataFrame:
    return v.agg(*_funnel())


def funnel_by_gender(v: DataFrame) -> DataFrame:
    return v.where("gender is not null").groupBy("gender").agg(*_funnel())


def valid_dwell(v: DataFrame) -> DataFrame:
    return v.where("dwell_s > 0")


QUANTILES = (("p25_s", 0.25), ("p50_s", 0.5), ("p90_s", 0.9))


def _quantiles(good: DataFrame, by: str) -> DataFrame:
    """Exact interpolated quantiles of dwell_s for each value of ``by``. No task holds a zone's stays: whole seconds
    are counted first (at most as many rows as the longest stay has seconds), then the values inside the few
    seconds that hold a wanted rank."""
    good = good.select(by, "dwell_s", F.floor("dwell_s").alias("second"))
    n = good.groupBy(by, "second").agg(F.count("*").alias("n"))
    zone = Window.partitionBy(by)
    n = n.withColumn("upto", F.sum("n").over(zone.orderBy("second"))).withColumn("total", F.sum("n").over(zone)).withColumn("before", F.col("upto") - F.col("n"))
    ranks = []
    for name, q in QUANTILES:
        at = (F.col("total") - 1) * F.lit(q)
        low, high = F.floor(at), F.ceil(at)
        ranks.append(F.struct(F.lit(name).alias("name"), low.alias("rank"), F.when(low == high, 1.0).otherwise(high - at).alias("share")))
        ranks.append(F.struct(F.lit(name).alias("name"), high.alias("rank"), (at - low).alias("share")))
    wanted = n.select(by, "second", "before", "upto", F.explode(F.array(*ranks)).alias("r")).where("r.rank >= before and r.rank < upto")
    wanted = wanted.select(by, "second", "r.name", (F.col("r.rank") - F.col("before")).alias("rank"), "r.share")  # six rows a zone
    values = good.join(F.broadcast(wanted.select(by, "second").distinct()), [by, "second"]).groupBy(by, "second", "dwell_s").agg(F.count("*").alias("n"))
    values = values.withColumn("upto", F.sum("n").over(Window.partitionBy(by, "second").orderBy("dwell_s")))
    found = values.join(F.broadcast(wanted), [by, "second"]).where("rank >= upto - n and rank < upto")
    return found.groupBy(by).agg(*[round_even(F.sum(F.when(F.col("name") == name, F.col("share") * F.col("dwell_s"))), 2).alias(name) for name, _ in QUANTILES])


def dwell_by_zone(v: DataFrame) -> DataFrame:
    good = valid_dwell(v).where("zone_id is not null")
    means = good.groupBy("zone_id").agg(F.count("*").alias("count"), round_even(F.avg("dwell_s"), 2).alias("mean_s"))
    return means.join(_quantiles(good, "zone_id"), "zone_id")


def dwell_overall(v: DataFrame) -> DataFrame:
    good = valid_dwell(v).withColumn("all", F.lit(0))
    mean = good.agg(round_even(F.avg("dwell_s"), 2).alias("mean_s"), F.lit(0).alias("all"))
    return mean.join(F.broadcast(_quantiles(good, "all")), "all", "left").drop("all")  # one row


def top_zones(v: DataFrame, n: int = 10) -> DataFrame:
    return dwell_by_zone(v).orderBy(F.desc("count"), "zone_id").limit(n)


def top_interior_zone(v: DataFrame) -> DataFrame:
    """The interior zone with most valid visits, null and 0 if there is none."""
    z = valid_dwell(v).where(is_interior(F.col("zone_id"))).groupBy("zone_id").agg(F.count("*").alias("n"))
    return z.agg(
        F.min_by("zone_id", F.struct(-F.col("n"), "zone_id")).alias("top_zone"), F.coalesce(F.max("n"), F.lit(0)).alias("top_zone_visits")
    )


def _day_hour(v: DataFrame) -> DataFrame:
    """Distinct persons of each day and hour, with the last day; days are few, so this is small."""
    days = v.where("visit_date is not null").groupBy("visit_date", "hour_of_day").agg(F.count_distinct("person_id").alias("uv"))
    last = v.agg(F.max("visit_date").alias("last_day"))
    return days.join(F.broadcast(last))  # one row


def baseline_hourly_stats(v: DataFrame) -> DataFrame:
    """Mean and deviation of each hour over the days before the last on which it was seen."""
    return _day_hour(v).where("visit_date < last_day").groupBy("hour_of_day").agg(
        F.avg("uv").alias("baseline_mean"), F.coalesce(F.stddev_samp("uv"), F.lit(0.0)).alias("baseline_std"), F.count("*").alias("n_days")
    )


def evalday_hourly(v: DataFrame) -> DataFrame:
    return _day_hour(v).where("visit_date = last_day").select("hour_of_day", F.col("uv").alias("unique_visitors"))


def traffic_anomalies(v: DataFrame, c: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Hours of the last day outside the baseline by more than sigma deviations; unseen hours are skipped."""
    both = evalday_hourly(v).join(F.broadcast(baseline_hourly_stats(v)), "hour_of_day")  # at most 24 rows
    hi, lo = F.col("baseline_mean") + c.sigma * F.col("baseline_std"), F.col("baseline_mean") - c.sigma * F.col("baseline_std")
    kind = F.when(F.col("unique_visitors") > hi, "high").when(F.col("unique_visitors") < lo, "low")
    hour = F.format_string("%02d:00", "hour_of_day")
    return both.withColumn("subtype", kind).where("subtype is not null").select(
        "hour_of_day",
        "subtype",
        "unique_visitors",
        round_even(F.col("baseline_mean"), 2).alias("baseline_mean"),
        round_even(F.col("baseline_std"), 2).alias("baseline_std"),
        round_even(hi, 2).alias("threshold_hi"),
        round_even(lo, 2).alias("threshold_lo"),
        F.concat(hour, F.lit(" "), "subtype", F.lit(" "), F.col("unique_visitors").cast("string")).alias("detail"),
    )


def dwell_anomalies(v: DataFrame, c: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Zones whose mean stay is far from the store's, in deviations of single stays."""
    good = valid_dwell(v)
    store = good.agg(F.avg("dwell_s").alias("store_mean"), F.stddev_samp("dwell_s").alias("store_std"))
    zones = good.where("zone_id is not null").groupBy("zone_id").agg(F.count("*").alias("n"), F.avg("dwell_s").alias("zone_mean"))
    z = (F.col("zone_mean") - F.col("store_mean")) / F.col("store_std")
    return (
        zones.join(F.broadcast(store))  # one row
        .where((F.col("n") >= c.least_visits) & (F.col("store_std") > 0))
        .withColumn("z", z)
        .where(F.abs("z") > c.dwell_z)
        .select("zone_id", "n", round_even(F.col("zone_mean"), 2).alias("zone_mean"), round_even(F.col("z"), 2).alias("z_score"))
    )


def anomaly_union(v: DataFrame, c: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Both kinds in one table, with what the baseline rests on."""
    days = v.where("visit_date is not null").select("visit_date").distinct().agg(F.count("*").alias("n_days"))
    warning = F.when(F.col("n_days") < 2, "too few days for a baseline").when(F.col("n_days") - 1 < c.least_baseline_days, "short baseline")
    t = traffic_anomalies(v, c).select(
        F.lit("traffic").alias("type"), "subtype", F.col("hour_of_day").cast("string").alias("subject"), F.col("unique_visitors").cast("double").alias("value")
    )
    d = dwell_anomalies(v, c).select(
        F.lit("dwell").alias("type"), F.when(F.col("z_score") > 0, "high").otherwise("low").alias("subtype"), F.col("zone_id").alias("subject"), F.col("zone_mean").alias("value")
    )
    return t.unionByName(d).join(F.broadcast(days.select("n_days", warning.alias("warning"))))  # one row
