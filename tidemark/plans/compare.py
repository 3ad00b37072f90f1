"""The comparison of two versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tidemark.operators.distribution import changed_categories, checked_columns, distribution_findings
from tidemark.operators.integrity import integrity_findings, schema_findings
from tidemark.operators.kpi import MetricsConfig, metric_findings
from tidemark.operators.profile import ColumnProfile, profile
from tidemark.plans import lens
from tidemark.plans.findings import DiffResult
from tidemark.sources.tables import normalised


def compute_diff(before: DataFrame, after: DataFrame, columns: list[ColumnProfile] | None = None, key: str | None = None, threshold: float = 0.10, metrics: MetricsConfig | None = None, as_of: Column | None = None) -> DiffResult:
    """Findings of schema, distribution, integrity and declared metrics, in this order; data stay on the executors."""
    before, after = normalised(before), normalised(after)
    columns = columns or profile(before, after)
    rows_b, rows_a, distribution = distribution_findings(before, after, columns, threshold)
    found = [*schema_findings(columns), *distribution, *integrity_findings(before, after, columns, key)]
    if metrics and metrics.has_metrics:
        found += metric_findings(before, after, metrics, as_of)
    categories = checked_columns(before, after, columns)["category"]
    return DiffResult(rows_b, rows_a, tuple(found), categories=changed_categories(before, after, categories) if categories else None)


def compare(before: DataFrame, after: DataFrame, scenario: str = "general", **how) -> DiffResult:
    return lens.apply(compute_diff(before, after, **how), scenario)
