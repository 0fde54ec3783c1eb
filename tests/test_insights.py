import datetime as dt
import json

import pytest

from trailweave.functions.text import sanitize
from trailweave.operators import audit, metrics
from trailweave.plans import documents, insights
from trailweave.sources import readers

METRICS = {"traffic": {"peak_hour": 12, "peak_unique_visitors": 40}, "funnel": {"unique_visitors": 100, "reached_checkout": 36}, "anomalies": {"anomaly_list": [{"detail": "x"}]}}


def test_numbers():
    assert insights.extract_numbers("3,960 Z_C2 36,19 12h00 0.85") == [3960, 36, 19, 0.85]
    assert insights.precision([("110 111 0", [100.0])])[1] == [111]
    assert insights.precision([("none", [1.0])]) == (1.0, [])


def test_scrubber():
    assert sanitize("Zone Z_C2 has 555 visitors .", [40.0], True) == "Zone Z_C2 has visitors."
    assert sanitize("Zone Z_C2", [40.0], False) == "Zone Z_C"


@pytest.mark.parametrize("raw, out", [("One.", ["One.", "", ""]), (list("abcde"), ["a", "b", "c"]), (None, ["", "", ""]), ("A. B! C? D.", ["A.", "B!", "C?"])])
def test_three_bullets(raw, out):
    assert insights.three(raw) == out


def test_parsing_repairs():
    doc = insights.parse('```json\n{"insights": [{"urgencia": "SOON", "confianca": 7}], "resumo_executivo": "A. B."}\n```')
    assert doc["insights"][0]["urgencia"] == "esta_semana" and doc["insights"][0]["confianca"] == 0.5 and doc["resumo_executivo"] == ["A.", "B.", ""]
    assert insights.parse("no json")["insights"] == []


def test_offline_run_and_report():
    doc = insights.run(METRICS)
    assert doc["hallucination_report"]["numeric_precision_zero_shot"] == 1.0
    text = documents.report(METRICS, doc, {"summary": {"all_targets_met": True}})
    assert "Peak hour: 12:00" in text and "## 8. Audit" in text and json.dumps(doc)
    assert documents.report(None, {"insights": []}).startswith("# Weekly report")


def test_wrong_numbers_are_removed():
    def liar(system, prompt):
        return json.dumps({"insights": [{"categoria": "traffic", "titulo": "t", "observacao": "777 people at 12"}], "resumo_executivo": []})

    assert insights.run(METRICS, liar)["insights"][0]["observacao"] == "people at 12"


def visit(spark, *rows):
    names = "person_id string, zone_id string, entry_us long, exit_us long, event_id long, gender string, age_code int"
    return spark.createDataFrame([(*r, i, "F", 3) for i, r in enumerate(rows)], names)


def test_coverage_counts_each_visit(spark):
    v = visit(spark, ("a", "Z_N1", 0, 10), ("b", "Z_N1", 5, 20))
    e = spark.createDataFrame([("Z_N1", 7)], "zone_id string, ts_us long")
    assert audit.coverage(v, e).first().coverage_pct == 200.0


def test_consistency_order(spark):
    v = visit(spark, ("a", "Z_N1", 0, 10), ("a", "Z_N1", 5, 20), ("b", "Z_N1", 0, 1))
    mixed = v.selectExpr("person_id", "zone_id", "entry_us", "exit_us", "event_id", "gender", "cast(event_id as int) as age_code")
    row = audit.consistency(mixed).first()
    assert (row.demographic_violations, row.overlap_violations, row.consistent) == (1, 0, 1)


def day_visits(spark, counts):
    rows = [(f"{d}-{i}", "Z_N1", 1.0, "F", dt.date(2024, 1, d), 9) for d, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "person_id string, zone_id string, dwell_s double, gender string, visit_date date, hour_of_day int")


@pytest.mark.parametrize("last, flags", [(6, ["high"]), (5, [])])
def test_flat_baseline(spark, last, flags):
    assert [r.subtype for r in metrics.traffic_anomalies(day_visits(spark, {1: 5, 2: last})).collect()] == flags


def test_empty_metrics(spark):
    v = day_visits(spark, {1: 1}).limit(0)
    doc = documents.metrics_document(v)
    assert doc["traffic"]["peak_hour"] is None and doc["funnel"]["conversion_rate"] == 0.0 and doc["dwell"]["top_zone"] is None


def test_sources(spark, tmp_path):
    (tmp_path / "zones.json").write_text('{"zones": {"Z_E1": {"walk_seconds": {"Z_N1": 10}}}}')
    assert {tuple(r) for r in readers.read_zones(spark, str(tmp_path / "zones.json")).collect()} == {("Z_E1", "Z_N1", 10), ("Z_N1", "Z_E1", 10)}
    (tmp_path / "e.csv").write_text("event_id,timestamp,zone_id,event_type,duration_s,gender,age_range\n1,2024-01-01 10:00:00,Z_E1,entry,,F,adult\n")
    assert readers.read_events(spark, str(tmp_path / "e.csv")).first().duration_s is None
    (tmp_path / "j.csv").write_text("person_id,zone_id,dwell_s,gender,visit_date,hour_of_day,entry_time\nP,Z_N1,oops,F,2024-01-01,x,2024-01-01 10:00:00\n")
    row = readers.read_journeys(spark, str(tmp_path / "j.csv")).first()
    assert row.dwell_s is None and row.hour_of_day is None
    (tmp_path / "bad.csv").write_text("person_id\nP\n")
    with pytest.raises(ValueError):
        readers.read_journeys(spark, str(tmp_path / "bad.csv"))


def test_an_answer_without_json_does_not_win():
    metrics = {"traffic": {"peak_hour": 12, "peak_unique_visitors": 40}}
    good = json.dumps({"insights": [{"id": 1, "categoria": "traffic", "titulo": "Peak", "observacao": "Hour 12 has 40 visitors.", "urgencia": "imediata", "confianca": 0.9}], "resumo_executivo": ["40 at 12."]})
    out = insights.run(metrics, lambda system, text: good if "Example" in text else "No JSON but 777 and 888 visitors")
    assert out["hallucination_report"]["numeric_precision_few_shot"] == 1.0 and len(out["insights"]) == 1
    only = insights.run(metrics, lambda system, text: "No JSON but 777 and 12 visitors", "zero_shot")
    assert only["insights"] == [] and only["hallucination_report"]["raw_precision_zero_shot"] == 0.5


def test_json_is_found_in_chatter():
    doc = {"insights": [], "resumo_executivo": ["a {b}"]}
    for text in ("x {not json} " + json.dumps(doc) + " and {more}", "```json\n" + json.dumps(doc) + "\n```", "Sure!\n" + json.dumps(doc, indent=1)):
        assert insights.parse(text)["resumo_executivo"] == ["a {b}", "", ""]
    assert insights.parse("nothing {here")["insights"] == []


def test_precision_of_a_document():
    of = lambda **x: documents.insights_precision({"hallucination_report": x})
    assert documents.insights_precision(None)["numeric_precision_pct"] == 0.0
    assert of()["numeric_precision_pct"] == 100.0
    assert of(numeric_precision_few_shot=0.5, numeric_precision_zero_shot=0.9, unverified_numbers_few_shot=[1.0])["numeric_precision_pct"] == 50.0
    assert of(numeric_precision_zero_shot=0.9)["strategy_used"] == "zero-shot"


def test_scrubber_of_built_ins_is_the_plain_one(spark):
    import random

    from pyspark.sql import functions as F

    from trailweave.functions import text as tx

    rng, known = random.Random(3), [5.0, 12.0, 40.0, 0.0]
    parts = ["12", "5.5", "5,2", "Z_S1", "x9", " ", "  ", ".", ",", "%", "n\n", "\t", "1,000", "40", "é7", "0", "0.05", "-3", "a", "1.2.3"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(600)] + [""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for whole in (False, True):
        got = [r[0] for r in df.select(tx.sanitize_column(F.col("t"), known, whole)).collect()]
        assert got == [tx.sanitize(t, known, whole) for t in texts]
    assert df.select(tx.sanitize_column(F.lit(None).cast("string"), known)).first()[0] is None


def test_first_object_is_the_plain_one(spark):
    import json

    from pyspark.sql import functions as F

    from trailweave.functions import text as tx
    from trailweave.plans.insights import _json

    texts = ['{"k": 1}', 'no {x} then {} and {"a": {"b": "}{"}} - end {"c": 2}', "```json\n{\"k\": [1, 2]}\n```", "nothing", "", '{"open": 1', '{ {"in": 3}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.first_object(F.col("t"))).collect()]
    assert [json.loads(x) if x else {} for x in got] == [_json(t) for t in texts] and got[3] is None


def test_flat_numbers_are_the_plain_ones(spark):
    import json
    from collections import Counter

    from trailweave.functions import text as tx
    from trailweave.plans.insights import values

    docs = [{"a": 1, "b": [2.5, "3 of 1,000", True, None, {"c": {"d": ["7 %", [], {}]}}]}, [], {}, "12 and 13", 4, True, None, {"5": "x6 7"}]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(99, "not {json"), (98, None)]
    got = tx.flat_numbers(spark.createDataFrame(rows, "id int, doc string"), "doc").collect()
    assert Counter((r.id, r.number) for r in got) == Counter((i, x) for i, d in enumerate(docs) for x in values(d))


def test_token_stream_and_its_errors(monkeypatch):
    """The model's answer comes as lines of JSON; no server, a time-out and an empty answer are told apart."""
    import io
    import urllib.error
    import urllib.request

    from trailweave.plans import insights

    asked = []

    def answer(lines):
        def opened(request, timeout=None):
            asked.append((request, timeout))
            if isinstance(lines, Exception):
                raise lines
            return io.BytesIO(lines)

        return opened

    def call(system, text):
        return insights.http_model("http://localhost:1/api", "small")(system, text)

    monkeypatch.setattr(urllib.request, "urlopen", answer(b'{"response": "Peak "}\n{"response": "12", "done": true}\n'))
    assert call("be brief", "when?") == "Peak 12" and asked[0][1] == 600
    for wrong in (urllib.error.URLError("refused"), TimeoutError(), b'{"response": "", "done": true}\n'):
        monkeypatch.setattr(urllib.request, "urlopen", answer(wrong))
        with pytest.raises(RuntimeError):
            call("be brief", "when?")
