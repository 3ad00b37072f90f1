"""Results as text, HTML and files."""

from __future__ import annotations

from html import escape
from string import Template

from tidemark.plans.findings import LAYERS, DiffResult
from tidemark.plans.lens import label

ICONS = {"FAIL": "❌", "WARN": "⚠️", "INFO": "ℹ️", "PASS": "✅"}
TITLES = {"schema": "Columns", "integrity": "Keys", "distribution": "Values", "custom": "Declared metrics"}


def _counts(result: DiffResult) -> dict[str, int]:
    n = lambda test: sum(map(test, result.findings))
    return {"failures": n(lambda f: f.severity == "FAIL"), "warnings": n(lambda f: f.severity == "WARN"), "custom": n(lambda f: f.layer == "custom")}


def text(result: DiffResult) -> str:
    counts = _counts(result)
    head = f"{ICONS[result.summary_severity]}  {result.summary_severity}  ·  {label(result.scenario)}  ·  {len(result.findings)} finding(s)" + (f"  ·  {counts['custom']} custom metric(s)" if counts["custom"] else "")
    lines = [head, "─" * len(head), f"Rows  {result.rows_before:,} → {result.rows_after:,}  {result.row_delta:+,} ({result.row_delta_pct:+.1%})"]
    for layer in LAYERS:
        found = [f for f in result.findings if f.layer == layer]
        if found:
            lines += ["", TITLES[layer], *(f"  {ICONS[f.severity]}  {f.title}" for f in found)]
    parts = [f"{counts[k]} {k[:-1]}(s)" for k in ("failures", "warnings") if counts[k]]
    return "\n".join([*lines, "", ", ".join(parts) or "No failures or warnings"])


PAGE = Template("""<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>Data comparison: $scenario</title>
<style>
body { font: 15px/1.5 system-ui, sans-serif; max-width: 60rem; margin: 2rem auto; padding: 0 1rem; color: #222; background: #fff }
.cards { display: flex; gap: 1rem; flex-wrap: wrap } .cards div { border: 1px solid #ccc; border-radius: 6px; padding: .6rem 1rem }
.cards b { display: block; font-size: 1.3rem } li { margin: .5rem 0; list-style: none } ul { padding: 0 }
.tag { display: inline-block; width: 3.5rem; text-align: center; border-radius: 4px; color: #fff; font-size: .8rem; margin-right: .5rem }
.FAIL { background: #b3261e } .WARN { background: #8a5a00 } .INFO { background: #0b57d0 } .PASS { background: #146c2e }
.detail { color: #555; margin-left: 4rem; white-space: pre-line }
</style></head><body>
<h1>Data comparison</h1><p>$scenario</p>
<div class="cards">$cards</div>
$layers
</body></html>
""")


def html(result: DiffResult) -> str:
    counts = _counts(result)
    cards = (("Verdict", result.summary_severity), ("Rows before", f"{result.rows_before:,}"), ("Rows after", f"{result.rows_after:,}"), ("Row change", f"{result.row_delta:+,} ({result.row_delta_pct:+.1%})"), ("Findings", f"{len(result.findings)} ({counts['failures']} FAIL, {counts['warnings']} WARN)"))
    parts = []
    for layer in LAYERS:
        found = [f for f in result.findings if f.layer == layer]
        if found:
            rows = "".join(f'<li><span class="tag {f.severity}">{f.severity}</span>{escape(f.title)}<div class="detail">{escape(f.detail)}</div></li>' for f in found)
            parts.append(f"<h2>{escape(TITLES[layer])}</h2><ul>{rows}</ul>")
    return PAGE.substitute(scenario=escape(label(result.scenario)), cards="".join(f"<div>{escape(k)}<b>{escape(v)}</b></div>" for k, v in cards), layers="\n".join(parts))


def write_html(result: DiffResult, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(html(result))


def exit_code(result: DiffResult) -> int:
    return int(result.summary_severity == "FAIL")
