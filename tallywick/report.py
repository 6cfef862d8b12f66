"""One self-contained HTML page from bounded aggregates.

Only what is shown reaches the driver: a dozen segments, cohort cells up to
offset 12 of the latest cohorts, the bins of a histogram, the heads of two lists.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from html import escape

from pyspark.sql import functions as F

from .operators import clv as clv_ops
from .operators.clv import ClvResult
from .operators.cohorts import CohortResult, compute_cohorts
from .operators.lists import CustomerLists, build_customer_lists
from .operators.quality import QualityReport, check_orders
from .operators.segments import RfmResult, build_advice, compute_rfm
from .sources.ingest import IngestResult

LAST_OFFSET, LIST_ROWS, ADVICE_ROWS, COHORTS_MOST = 12, 15, 8, 240
STYLE = (
    "body{font:15px/1.5 system-ui,sans-serif;margin:2rem auto;max-width:64rem;color:#222}"
    "section{margin:2rem 0}table{border-collapse:collapse;width:100%}td,th{padding:.3rem .6rem;border-bottom:1px solid #ddd;text-align:left}"
    ".n{text-align:right}.tiles{display:flex;gap:1rem;flex-wrap:wrap}.tile{border:1px solid #ccc;border-radius:.5rem;padding:.7rem 1rem}"
    ".tile b{display:block;font-size:1.4rem}.bar{background:#3567c9;height:.7rem;display:inline-block}.none{color:#888}"
)


@dataclass(frozen=True)
class ReportInputs:
    ingest: IngestResult
    quality: QualityReport
    rfm: RfmResult
    cohorts: CohortResult
    clv: ClvResult
    lists: CustomerLists
    store_name: str = "Your store"


def analyse(ingested: IngestResult, n_segments: int = 5, horizon_months: int = 12, clv_method: str = "auto", store: str = "Your store") -> ReportInputs:
    """All that a report shows, from ingested orders."""
    orders = ingested.orders.cache()
    rfm = compute_rfm(orders, n_segments=n_segments)
    value = clv_ops.compute_clv(orders, horizon_months=horizon_months, method=clv_method)
    for table in (rfm.table, value.table):
        table.cache()
    return ReportInputs(ingested, check_orders(orders), rfm, compute_cohorts(orders), value, build_customer_lists(rfm, value), store)


def money(x: float) -> str:
    return f"{x:,.0f}"


def tile(value: str, label: str) -> str:
    return f"<div class=tile><b>{escape(value)}</b>{escape(label)}</div>"


def grid(headers: list[str], rows: list[list[str]], numeric: set[int] = frozenset()) -> str:
    """A table of cells that are HTML already."""
    mark = lambda k: " class=n" if k in numeric else ""
    head = "".join(f"<th{mark(k)}>{escape(h)}</th>" for k, h in enumerate(headers))
    body = "".join("<tr>" + "".join(f"<td{mark(k)}>{c}</td>" for k, c in enumerate(r)) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def shade(share: float | None) -> str:
    """White for 0 to strong blue for 1; null has the page's colour."""
    if share is None or share != share:
        return "#ffffff"
    weight = min(1.0, max(0.0, share))
    return "#" + "".join(f"{round(255 - weight * (255 - full)):02x}" for full in (0x2F, 0x5F, 0xC4))


def line_chart(points: list[tuple[int, float]], width: int = 480, height: int = 120) -> str:
    """An inline curve; nothing for fewer than two points."""
    if len(points) < 2:
        return ""
    low, high = points[0][0], points[-1][0]
    place = [(20 + (x - low) / (high - low) * (width - 40), 15 + (1 - y) * (height - 30)) for x, y in points]
    line = " ".join(f"{x:.1f},{y:.1f}" for x, y in place)
    return f"<svg width={width} height={height} role=img><polyline points='{line}' fill=none stroke='#2f5fc4' stroke-width=2 /></svg>"


def bar_chart(bins: list[tuple[float, float, int]], width: int = 480, height: int = 130) -> str:
    most = max((n for *_, n in bins), default=0)
    if not most:
        return "<p class=none>No customer has a positive value.</p>"
    step = (width - 20) / len(bins)
    bars = "".join(f"<rect x={10 + k * step:.1f} y={height - 15 - n / most * (height - 30):.1f} width={step - 2:.1f} height={n / most * (height - 30):.1f} fill='#2f5fc4'><title>{n} customers from {a:.0f} to {b:.0f}</title></rect>" for k, (a, b, n) in enumerate(bins))
    return f"<svg width={width} height={height} role=img>{bars}</svg>"


def _segments(rfm: RfmResult) -> str:
    rows = rfm.segment_summary.collect()
    most = max((r.total_revenue for r in rows), default=0) or 1
    return grid(
        ["Segment", "Customers", "Share", "Days since order", "Orders", "Spend", "Revenue share"],
        [[escape(r.segment), f"{r.customers:,}", f"{r.pct_customers:.1f}%", f"{r.avg_recency:.0f}", f"{r.avg_frequency:.1f}", money(r.avg_monetary), f"<span class=bar style='width:{max(0, r.total_revenue) / most * 8:.2f}rem'></span> {r.pct_revenue:.1f}%"] for r in rows],
        {1, 2, 3, 4, 5},
    )


def _cohorts(result: CohortResult) -> str:
    shown = result.long.where(F.col("month_offset") <= LAST_OFFSET)
    latest = [r.cohort for r in result.sizes.orderBy(F.desc("cohort")).limit(COHORTS_MOST).collect()]
    cells = {(r.cohort, r.month_offset): r for r in shown.where(F.col("cohort").isin(latest)).collect()}
    last = max((o for _, o in cells), default=0)
    rows = []
    for c in sorted({c for c, _ in cells}):
        row = [escape(c), f"{cells[c, 0]['size']:,}"]
        for o in range(last + 1):
            cell = cells.get((c, o))
            row.append("<span class=none>·</span>" if cell is None else f"<span style='background:{shade(cell.retention)}'>{cell.retention * 100:.0f}%</span>")
        rows.append(row)
    return grid(["Cohort", "Size", *[f"M{o}" for o in range(last + 1)]], rows)


def _list(df) -> str:
    rows = df.limit(LIST_ROWS).collect()
    if not rows:
        return "<p class=none>None.</p>"
    return grid(["Customer", "Segment", "Spent", "Orders", "Days since", "Predicted value"], [[escape(r.customer_id), escape(r.segment), money(r.monetary), str(r.frequency), str(r.recency_days), money(r.predicted_clv)] for r in rows], {2, 3, 4, 5})


def _advice(rfm: RfmResult) -> str:
    rows = build_advice(rfm.segment_summary).limit(ADVICE_ROWS).collect()
    bullets = lambda text: "<ul>" + "".join(f"<li>{escape(t.strip())}</li>" for t in text.split(";")) + "</ul>"
    return grid(["Segment", "What to do", "Channels", "Revenue"], [[escape(r.segment), escape(r.strategy) + bullets(r.tactics), escape(r.channels), f"{r.pct_revenue:.1f}%"] for r in rows], {3})


def render_html(inputs: ReportInputs, now: datetime | None = None) -> str:
    q, clv, store = inputs.quality, inputs.clv, escape(inputs.store_name)
    repeat = inputs.rfm.table.agg(F.avg(F.when(F.col("frequency") > 1, 100.0).otherwise(0.0))).first()[0] or 0.0
    value = clv.summary
    curve = [(r.month_offset, r.retention) for r in inputs.cohorts.curve.where(F.col("month_offset") <= LAST_OFFSET).collect() if r.retention is not None]
    bins = [(r.low, r.high, r.customers) for r in clv_ops.clv_histogram(clv.table).collect()]
    method = "BG/NBD and Gamma-Gamma" if clv.method != "heuristic" else "closed form"
    notes = "".join(f"<li>{escape(f.level)}: {escape(f.message)}</li>" for f in q.findings)
    n_churn, n_best = inputs.lists.churn_risk.count(), inputs.lists.high_value.count()
    sections = [
        ("Overview", "<div class=tiles>" + tile(f"{q.n_customers:,}", "customers") + tile(money(q.total_revenue), "revenue") + tile(money(q.total_revenue / q.n_rows if q.n_rows else 0), "average order") + tile(f"{repeat:.0f}%", "bought again") + tile(money(value["total_clv"]), f"value over {clv.horizon_months} months") + "</div>" + (f"<h3>Notes on the data</h3><ul>{notes}</ul>" if notes else "")),
        ("RFM segments", _segments(inputs.rfm)),
        ("Monthly retention cohorts", line_chart(curve) + _cohorts(inputs.cohorts)),
        ("Customer lifetime value", f"<p>By {method}.</p><div class=tiles>" + tile(money(value["mean_clv"]), "mean") + tile(money(value["median_clv"]), "median") + tile(f"{value['top_decile_share']:.0f}%", "from the top tenth") + "</div>" + bar_chart(bins)),
        ("Customer action lists", f"<h3>Win back ({n_churn:,})</h3>{_list(inputs.lists.churn_risk)}<h3>Best customers ({n_best:,})</h3>{_list(inputs.lists.high_value)}"),
        ("Marketing playbook", _advice(inputs.rfm)),
    ]
    made = (now or datetime.now()).strftime("%Y-%m-%d %H:%M")
    head = f"<!doctype html><html lang=en><head><meta charset=utf-8><title>Customer insights: {store}</title><style>{STYLE}</style></head><body>"
    top = f"<h1>Customer insights</h1><p>{store}, {made}: {q.n_rows:,} orders from {q.date_min:%Y-%m-%d} to {q.date_max:%Y-%m-%d}, columns by {escape(inputs.ingest.preset)}</p>"
    return head + top + "".join(f"<section><h2>{escape(t)}</h2>{b}</section>" for t, b in sections) + "</body></html>"


def write_report(inputs: ReportInputs, path: str) -> str:
    with open(path, "w", encoding="utf-8") as f:
        f.write(render_html(inputs))
    return path
