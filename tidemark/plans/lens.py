"""Scenarios: what a use case takes more or less seriously."""

from __future__ import annotations

from dataclasses import replace

from tidemark.plans.findings import LAYERS, SEVERITIES, DiffResult

#: scenario: (label, layers promoted, layers demoted); fixed values.
SCENARIOS = {
    "etl": ("ETL Validation", ("schema", "integrity"), ()),
    "migration": ("Data Migration", ("integrity", "schema"), ("distribution",)),
    "ab-test": ("A/B Test Balance Check", ("distribution",), ("integrity",)),
    "general": ("General Diff", (), ()),
}


def label(scenario: str) -> str:
    return SCENARIOS[scenario][0] if scenario in SCENARIOS else scenario


def adjusted(severity: str, layer: str, scenario: str) -> str:
    _, up, down = SCENARIOS.get(scenario, SCENARIOS["general"])
    step = 0 if layer == "custom" else 1 if layer in up else -1 if layer in down else 0
    return SEVERITIES[min(3, max(0, SEVERITIES.index(severity) + step))]


def apply(result: DiffResult, scenario: str) -> DiffResult:
    """Severities re-weighted and findings sorted, worst first; an unknown scenario changes no severity."""
    found = [replace(f, severity=adjusted(f.severity, f.layer, scenario)) for f in result.findings]
    found.sort(key=lambda f: (-SEVERITIES.index(f.severity), LAYERS.index(f.layer) if f.layer in LAYERS else len(LAYERS)))
    return replace(result, findings=tuple(found), scenario=scenario)
