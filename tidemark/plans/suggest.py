"""A first metrics file for a dataset, from a summary of its columns; rules by default, or a provider's YAML."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import yaml
from pyspark.sql import DataFrame

from tidemark.operators.profile import column_summary, semantic_types


def suggest(df: DataFrame, business: str) -> dict:
    """A metric of completeness for ids, rates for the values of small categories, staleness for dates and means for numbers."""
    classes, metrics = semantic_types(df), []
    for c in column_summary(df):
        name, kind = c["name"], classes.get(c["name"])
        if kind == "id":
            metrics.append({"name": f"{name}_completeness", "type": "completeness", "column": name, "warn_if_below": 0.999, "fail_if_below": 0.99})
        elif kind == "category" and (c["n_unique"] or 0) <= 10:
            metrics += [{"name": f"{name}_{v}_rate", "type": "rate", "column": name, "match_value": v, "warn_if_delta_pct": 0.2} for v in sorted(set(c["sample"]))]
        elif kind == "datetime":
            metrics.append({"name": f"{name}_staleness", "type": "staleness", "column": name, "threshold_days": 90, "warn_if_above": 0.2, "fail_if_above": 0.4})
        elif kind == "numeric":
            metrics.append({"name": f"{name}_mean", "type": "custom", "column": name, "expression": f"df[{name!r}].mean()", "warn_if_delta_pct": 0.1, "fail_if_delta_pct": 0.25})
    return {"business_context": business, "metrics": metrics}


def prompt(df: DataFrame, business: str) -> str:
    return f"Business: {business}\nColumns:\n{json.dumps(column_summary(df), indent=2, ensure_ascii=False)}\nWrite a metrics YAML: business_context and a list metrics."


def write_metrics(df: DataFrame, business: str, path: str = "metrics.yaml", provider: Callable[[str], str] | None = None) -> str:
    """The file written: path, metrics_generated.yaml beside it if path exists, or metrics_draft.yaml if the YAML is not usable."""
    folder = os.path.dirname(path) or "."
    written = provider(prompt(df, business)) if provider else yaml.safe_dump(suggest(df, business), sort_keys=False, allow_unicode=True)
    try:
        parsed = yaml.safe_load(written)
        usable = isinstance(parsed, dict) and "metrics" in parsed
    except yaml.YAMLError:
        usable = False
    target = os.path.join(folder, "metrics_draft.yaml") if not usable else os.path.join(folder, "metrics_generated.yaml") if os.path.exists(path) else path
    with open(target, "w", encoding="utf-8") as f:
        f.write(written)
    return target
