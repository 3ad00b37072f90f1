"""Command line: `diff` compares two sources, `init` writes a first metrics file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidemark.operators import kpi
from tidemark.plans import lens, suggest
from tidemark.plans.compare import compare
from tidemark.sinks import narrative, render
from tidemark.sources.tables import load
from tidemark.streaming.watch import watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("diff", help="compare two versions of a table")
    d.add_argument("before")
    d.add_argument("after")
    d.add_argument("-s", "--scenario", choices=sorted(lens.SCENARIOS), default="general")
    d.add_argument("-k", "--key")
    d.add_argument("-t", "--threshold", type=float, default=0.10)
    d.add_argument("-m", "--metrics")
    d.add_argument("--no-metrics", action="store_true")
    d.add_argument("--story", action="store_true")
    d.add_argument("--llm", help=f"who writes the story: {', '.join(narrative.SERVICES)} (each with its key in the environment); a template by default")
    d.add_argument("--split-by", help="column by whose ranges a database's table is read")
    d.add_argument("-e", "--export", help="write an HTML report")
    d.add_argument("--json", action="store_true")
    d.add_argument("-w", "--watch", action="store_true")
    i = sub.add_parser("init", help="write a first metrics file")
    i.add_argument("-f", "--from", dest="source", required=True)
    i.add_argument("-b", "--business", required=True)
    i.add_argument("-o", "--output", default="metrics.yaml")
    return p


def _diff(spark: SparkSession, a: argparse.Namespace) -> int:
    metrics = None
    if not a.no_metrics:
        try:
            metrics = kpi.load(a.metrics)
        except (ValueError, OSError) as e:
            print(f"metrics are skipped: {e}", file=sys.stderr)
    print(f"Loading {a.before} and {a.after}", file=sys.stderr)
    result = compare(load(spark, a.before, split_by=a.split_by), load(spark, a.after, split_by=a.split_by), a.scenario, key=a.key, threshold=a.threshold, metrics=metrics)
    print(result.to_json() if a.json else render.text(result))
    if a.story and (told := narrative.story(result, metrics, a.llm)):
        print(f"\n{told}", file=sys.stderr if a.json else sys.stdout)
    if a.export:
        render.write_html(result, a.export)
    return render.exit_code(result)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    try:
        if a.command == "init":
            print(suggest.write_metrics(load(spark, a.source), a.business, a.output))
            return 0
        code = _diff(spark, a)
        if a.watch:
            try:
                watch((a.before, a.after), lambda: _diff(spark, a), failed=lambda e: print(f"waiting for the next change: {e}", file=sys.stderr))
            except KeyboardInterrupt:
                pass
        return code
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
