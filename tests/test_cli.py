import json

from trailweave.__main__ import main


def test_whole_run(spark, tmp_path, capsys):
    rows = ["event_id,timestamp,zone_id,event_type,duration_s,gender,age_range"]
    for p in range(6):
        for k, (zone, kind) in enumerate([("Z_E1", "entry"), ("Z_N1", "entry"), ("Z_N1", "linger"), ("Z_N1", "exit"), ("Z_N1", "entry"), ("Z_CK", "entry"), ("Z_CK", "exit")]):
            at = p * 1000 + k * 20 + (200 if k > 3 else 0)  # out of sight for over three minutes, so healing joins the parts
            rows.append(f"{p * 10 + k},2024-01-0{p % 3 + 1} 10:{at % 3600 // 60:02d}:{at % 60:02d},{zone},{kind},{30 if kind == 'linger' else ''},F,adult")
    (tmp_path / "events.csv").write_text("\n".join(rows) + "\n")
    (tmp_path / "zones.json").write_text(json.dumps({"zones": {"Z_E1": {"walk_seconds": {"Z_N1": 10}}, "Z_N1": {"walk_seconds": {"Z_CK": 10}}}}))
    f = lambda n: str(tmp_path / n)
    assert main(["stitch", "--events", f("events.csv"), "--zones", f("zones.json"), "--output", f("journeys")]) == 0
    assert main(["analyze", "--journeys", f("journeys"), "--output", f("metrics.json")]) == 0
    assert "merged_a" in capsys.readouterr().out
    assert main(["insights", "--metrics", f("metrics.json"), "--output", f("insights.json")]) == 0
    assert main(["audit", "--events", f("events.csv"), "--journeys", f("journeys"), "--insights", f("insights.json"), "--output", f("audit.json")]) == 0
    assert "numeric_precision   100.00 %  met" in capsys.readouterr().out
    assert main(["report", "--metrics", f("metrics.json"), "--insights", f("insights.json"), "--audit", f("audit.json"), "--output", f("report.md")]) == 0
    assert "## 8. Audit" in (tmp_path / "report.md").read_text()
    assert main(["audit", "--events", f("events.csv"), "--journeys", f("journeys"), "--output", f("audit.json")]) == 0
    assert json.loads((tmp_path / "audit.json").read_text())["summary"]["numeric_precision_pct"] == 0
    assert main(["analyze", "--journeys", f("nowhere"), "--output", f("x.json")]) == 1
    assert json.loads((tmp_path / "metrics.json").read_text())["traffic"]["total_unique_visitors"] == 6
    assert "# Weekly report" in (tmp_path / "report.md").read_text()
    assert main(["report", "--metrics", f("metrics.json"), "--insights", f("none.json"), "--output", f("r.md")]) == 1
