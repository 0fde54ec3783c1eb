"""Metrics and audit documents, and the Markdown report, from small results."""

from __future__ import annotations

import json
import math
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row

from trailweave.functions.text import URGENCIES
from trailweave.operators import audit as au
from trailweave.operators import metrics as m

BADGES = {"imediata": "🔴", "esta_semana": "🟡", "proximo_mes": "🟢"}
LABELS = {"imediata": "Now", "esta_semana": "This week", "proximo_mes": "Next month"}
SECTIONS = (
    ("Traffic", ("tráfego", "traffic", "hora", "hour")),
    ("Conversion", ("conversão", "conversion", "funil")),
    ("Dwell", ("permanência", "dwell", "zona")),
    ("Anomalies", ("anomalia", "anomaly")),
)


def _native(x: Any) -> Any:
    if isinstance(x, Row):
        return {k: _native(v) for k, v in x.asDict().items()}
    if isinstance(x, (list, tuple)):
        return [_native(v) for v in x]
    if isinstance(x, float) and math.isnan(x):
        return None
    return x.isoformat() if hasattr(x, "isoformat") else x


def _rows(df: DataFrame) -> list[dict]:
    """At most some tens of rows: hours, zones, days or totals."""
    return [_native(r) for r in df.collect()]


def metrics_document(v: DataFrame, source: str = "journeys") -> dict:
    """The whole metrics document. Visits are kept in memory over its dozen small aggregates."""
    v = v.select("person_id", "zone_id", "dwell_s", "gender", "visit_date", "hour_of_day").persist()
    try:
        totals, peak, top = _rows(m.traffic_totals(v))[0], _rows(m.peak_quiet_hour(v))[0], _rows(m.top_interior_zone(v))[0]
        found = _rows(m.anomaly_union(v))
        days = sorted(str(r["visit_date"]) for r in _rows(v.select("visit_date").distinct()) if r["visit_date"])
        return {
            "meta": {"source_file": source, "n_rows": totals["total_visits"], "generated_by": "trailweave"},
            "traffic": totals | peak | {"by_hour_top10": _rows(m.top_hours(v))},
            "funnel": _rows(m.funnel_overall(v))[0] | {"gender_breakdown": {r.pop("gender"): r for r in _rows(m.funnel_by_gender(v))}},
            "dwell": {"overall": _rows(m.dwell_overall(v))[0]} | top | {"by_zone_top10": _rows(m.top_zones(v))},
            "anomalies": {
                "n_anomalies": len(found),
                "baseline_meta": {"method": "mean and deviation by hour", "sigma_threshold": 2.0, "n_days_available": len(days), "baseline_days": days[:-1], "evaluation_day": days[-1] if days else None},
                "anomaly_list": found,
            },
        }
    finally:
        v.unpersist()


def insights_precision(doc: dict | None) -> dict:
    """Numeric precision of an insights document: few-shot before zero-shot, 100 with neither, 0 without a document."""
    if doc is None:
        return {"numeric_precision_pct": 0.0}
    found = doc.get("hallucination_report", {})
    few, zero = (found.get(f"numeric_precision_{n}") for n in ("few_shot", "zero_shot"))
    share = next((x for x in (few, zero) if x is not None), 1.0)
    bad = found.get("unverified_numbers_few_shot") or found.get("unverified_numbers_zero_shot") or []
    return {"numeric_precision_pct": round(float(share) * 100.0, 2), "strategy_used": "zero-shot" if few is None else "few-shot", "unverified_count": len(bad)}


def audit_document(visits: DataFrame, events: DataFrame, insights: dict | None = None) -> dict:
    told = insights_precision(insights)
    return {
        "metrics": {
            "coverage": _rows(au.coverage(visits, events))[0],
            "completeness": _rows(au.completeness(visits))[0],
            "consistency": _rows(au.consistency(visits))[0],
            "numeric_precision": told,
        },
        "summary": _rows(au.audit(visits, events, told["numeric_precision_pct"]))[0],
    }


def stitch_summary(counters: dict[str, int], ratios: dict) -> str:
    lines = ["Stitching", *[f"  {k:<24} {n:>12,}" for k, n in sorted(counters.items())]]
    lines += [f"  {k:<24} {v:>12,.2f}" if isinstance(v, float) else f"  {k:<24} {v:>12,}" for k, v in ratios.items()]
    return "\n".join(lines)


def metrics_summary(doc: dict) -> str:
    t, f, d = doc["traffic"], doc["funnel"], doc["dwell"]
    lines = [
        "Metrics",
        f"  visitors    {_n(t.get('total_unique_visitors'))} in {_n(t.get('total_visits'))} visits",
        f"  peak hour   {_n(t.get('peak_hour'), '{:02d}:00')} with {_n(t.get('peak_unique_visitors'))}; quiet {_n(t.get('quiet_hour'), '{:02d}:00')} with {_n(t.get('quiet_unique_visitors'))}",
        f"  conversion  {_n(f.get('conversion_rate'), '{:.2f} %')} ({_n(f.get('reached_checkout'))} of {_n(f.get('unique_visitors'))})",
        *[f"    {g:<9} {_n(x.get('conversion_rate'), '{:.2f} %')}" for g, x in sorted(f.get("gender_breakdown", {}).items())],
        f"  mean stay   {_n(d['overall'].get('mean_s'), '{:.1f} s')}; top zone {_n(d.get('top_zone'), '{}')} with {_n(d.get('top_zone_visits'))} visits",
        f"  anomalies   {doc['anomalies']['n_anomalies']}",
        *[f"    {a.get('type')} {a.get('subtype')}: {a.get('subject')} ({_n(a.get('value'), '{:,.1f}')})" for a in doc["anomalies"]["anomaly_list"]],
    ]
    return "\n".join(lines)


def audit_summary(doc: dict) -> str:
    s = doc["summary"]
    names = ("coverage", "completeness", "consistency", "numeric_precision")
    lines = [f"  {n:<18} {s[f'{n}_pct']:>7.2f} %  {'met' if s[f'{n}_met'] else 'missed'}" for n in names]
    return "\n".join(["Audit", *lines, f"  all targets        {'met' if s['all_targets_met'] else 'missed'}"])


def insights_summary(doc: dict) -> str:
    lines = ["Insights"]
    for i in doc["insights"]:
        lines.append(f"  {BADGES.get(i.get('urgencia'), '⚪')} {i.get('titulo', '')} [{i.get('categoria', '')}, {_n(i.get('confianca'), '{:.0%}')}]")
    lines += [f"  - {b}" for b in doc["resumo_executivo"] if b]
    lines += [f"  {k}: {v if not isinstance(v, list) else len(v)}" for k, v in doc["hallucination_report"].items()]
    return "\n".join(lines)


def write_json(doc: dict, path: str) -> None:
    Path(path).write_text(json.dumps(doc, ensure_ascii=False, indent=2), encoding="utf-8")


def _n(x: Any, form: str = "{:,}") -> str:
    return "N/A" if x is None else form.format(x)


def _cell(text: Any) -> str:
    return str(text).replace("|", "\\|")


def report(metrics: dict | None, insights: dict, audit: dict | None = None) -> str:
    """The weekly report: figures, summary, urgencies, a section for each category, recommendations, audit."""
    metrics = metrics or {}
    t, f, d = metrics.get("traffic", {}), metrics.get("funnel", {}), metrics.get("dwell", {}).get("overall", {})
    items = insights.get("insights", [])
    lines = ["# Weekly report", "", "## 1. Figures", ""]
    lines += [
        f"- Visitors: {_n(t.get('total_unique_visitors'))} in {_n(t.get('total_visits'))} visits",
        f"- Peak hour: {_n(t.get('peak_hour'), '{:02d}:00')}, quiet hour: {_n(t.get('quiet_hour'), '{:02d}:00')}",
        f"- Conversion: {_n(f.get('conversion_rate'), '{:.1f}%')}",
        f"- Mean stay: {_n(d.get('mean_s'), '{:.0f} s')}",
        "",
        "## 2. Summary",
        "",
        *[f"- {b}" for b in insights.get("resumo_executivo", []) if b.strip()],
        "",
        "| Urgency | Insights |",
        "|-|-|",
        *[f"| {BADGES[u]} {LABELS[u]} | {sum(i.get('urgencia') == u for i in items)} |" for u in URGENCIES],
        "",
    ]
    for k, (name, words) in enumerate(SECTIONS, 3):
        own = [i for i in items if str(i.get("categoria", "")).lower() in words]  # as checks.section_items
        own = own or [i for i in items if any(w in str(i.get("categoria", "") + " " + i.get("titulo", "")).lower() for w in words)]
        lines += [f"## {k}. {name}", ""]
        for i in own:
            lines += [f"**{BADGES.get(i.get('urgencia'), '⚪')} {i.get('titulo', '')}** ({_n(i.get('confianca'), '{:.0%}')})", "", *[str(i[x]) for x in ("observacao", "implicacao", "recomendacao") if i.get(x)], ""]
        lines += [] if own else ["Nothing to report.", ""]
    rank = {u: n for n, u in enumerate(URGENCIES)}
    lines += ["## 7. Recommendations", "", "| Urgency | Insight | Recommendation |", "|-|-|-|"]
    for i in sorted(items, key=lambda i: rank.get(i.get("urgencia"), len(rank))):
        lines.append(f"| {LABELS.get(i.get('urgencia'), i.get('urgencia'))} | {_cell(i.get('titulo', ''))} | {_cell(i.get('recomendacao', ''))} |")
    if audit:
        lines += ["", "## 8. Audit", "", *[f"- {k}: {v}" for k, v in audit.get("summary", {}).items()]]
    return "\n".join(lines) + "\n"
