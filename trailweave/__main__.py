"""Command line: python -m trailweave stitch | analyze | audit | insights | report."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def edges_of(path: str):
    from trailweave.schema import Zones

    raw = json.loads(Path(path).read_text(encoding="utf-8"))["zones"]
    return Zones(tuple((a, b, int(w)) for a, z in raw.items() for b, w in z.get("walk_seconds", {}).items()))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trailweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, inputs in {"stitch": "events zones", "analyze": "journeys", "audit": "events journeys", "insights": "metrics", "report": "metrics insights"}.items():
        p = commands.add_parser(name)
        for x in inputs.split():
            p.add_argument(f"--{x}", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--format", default="csv", help="of events and journeys")
        if name == "audit":
            p.add_argument("--insights", help="the insights whose numeric precision counts; 0 without them")
        if name == "report":
            p.add_argument("--audit", help="an audit to add as a section")
        if name == "insights":
            p.add_argument("--model-url", help="of a local endpoint; without it, answers come from the metrics")
            p.add_argument("--model", default="llama3.1:8b")
            p.add_argument("--strategy", default="both", choices=["both", "zero_shot", "few_shot"])
    a = parser.parse_args(args)
    if a.command in ("insights", "report"):
        return _documents(a)
    if missing := [x for n in ("events", "zones", "journeys") if (x := getattr(a, n, None)) and "://" not in x and not Path(x).exists()]:
        print(f"missing: {', '.join(missing)}")
        return 1
    spark = SparkSession.builder.appName(f"trailweave {a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from trailweave.functions.scalar import age_code, micros
    from trailweave.operators import stitch
    from trailweave.plans import documents, journey
    from trailweave.sources import readers

    if a.command == "stitch":
        found = journey.run(spark, stitch.from_events(readers.read_events(spark, a.events, a.format)), edges_of(a.zones))
        readers.journeys(found["trajectories"].withColumn("id", F.format_string("P_%06d", "frag_id"))).write.mode("overwrite").format(a.format).option("header", True).save(a.output)
        counters = {r.counter: r.n for r in found["telemetry"].collect()}  # some tens of counters
        print(documents.stitch_summary(counters, found["ratios"].first().asDict()))
    elif a.command == "analyze":
        doc = documents.metrics_document(readers.read_journeys(spark, a.journeys, a.format), a.journeys)
        documents.write_json(doc, a.output)
        print(documents.metrics_summary(doc))
    else:
        v = readers.read_journeys(spark, a.journeys, a.format)
        v = v.select("person_id", "zone_id", micros(F.col("entry_time")).alias("entry_us"), micros(F.col("exit_time")).alias("exit_us"), F.monotonically_increasing_id().alias("event_id"), "gender", age_code(F.col("age_range")).alias("age_code"))
        e = readers.read_events(spark, a.events, a.format).select("zone_id", micros(F.col("timestamp")).alias("ts_us"))
        doc = documents.audit_document(v, e, _read(a.insights))
        documents.write_json(doc, a.output)
        print(documents.audit_summary(doc))
    return 0


def _read(path: str | None) -> dict | None:
    return json.loads(Path(path).read_text(encoding="utf-8")) if path and Path(path).exists() else None


def _documents(a: argparse.Namespace) -> int:
    from trailweave.plans import documents, insights

    metrics = _read(a.metrics)
    if a.command == "insights":
        if metrics is None:
            print(f"missing: {a.metrics}")
            return 1
        model = insights.http_model(a.model_url, a.model) if a.model_url else insights.offline
        doc = insights.run(metrics, model, a.strategy)
        documents.write_json(doc, a.output)
        print(documents.insights_summary(doc))
        return 0
    found = _read(a.insights)
    if found is None:
        print(f"missing: {a.insights}")
        return 1
    Path(a.output).write_text(documents.report(metrics, found, _read(a.audit)), encoding="utf-8")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
