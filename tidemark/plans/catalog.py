"""The registered queries of the comparison engine and their equivalents in SQL.

Most run on a drift pair made of `orders` (drift is injected, as the tables have none); both engines build it from the same text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.kolmogorov import p_value
from tidemark.functions.timestamps import days_since, parsed
from tidemark.operators import distribution as dist
from tidemark.operators import kpi
from tidemark.operators.integrity import key_counts, key_status, schema_findings
from tidemark.operators.profile import column_summary as summaries
from tidemark.operators.profile import profile, semantic_types
from tidemark.plans import lens, oracles
from tidemark.plans.compare import compare
from tidemark.plans.findings import DiffResult
from tidemark.sinks import narrative, render

BEFORE = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 20 <> 0"
_BASE = (
    "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'F' WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, "
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice * 1.15 END AS o_totalprice, o_orderdate + INTERVAL 30 DAY AS o_orderdate, o_orderpriority "
    "FROM {orders} WHERE o_orderkey % 20 <> 1 AND o_orderpriority <> '5-LOW'"
)
AFTER = f"{_BASE} UNION ALL SELECT * FROM ({_BASE}) d WHERE o_orderkey % 50 = 3"
EVENTS_BEFORE = "SELECT event_id, ts, user_id, event_type, value, props FROM {events} WHERE event_id % 10 <> 0"
EVENTS_AFTER = "SELECT event_id, ts, user_id, CASE WHEN event_type = 'signup' THEN 'register' ELSE event_type END AS event_type, CAST(value AS VARCHAR(20)) AS value, CAST(event_id % 3 AS INTEGER) AS channel FROM {events} WHERE event_id % 10 <> 1"
LINES_BEFORE = "SELECT * FROM {lineitem} WHERE l_linenumber <= 3"
LINES_AFTER = (
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity * 1.05 AS l_quantity, l_extendedprice, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount END AS l_discount, "
    "l_tax * l_tax * 16 AS l_tax, l_returnflag, l_linestatus, l_shipdate FROM {lineitem} WHERE l_linenumber > 3"
)
NUMERIC, CATEGORY = ("o_custkey", "o_totalprice"), ("o_orderstatus", "o_orderpriority")
COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
AS_OF = "2001-09-01"
TIMES = 0.10


def _pair(spark: SparkSession, sf_dir: str, table: str, before: str, after: str) -> tuple[DataFrame, DataFrame]:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(before, **{table: df}), spark.sql(after, **{table: df})


def orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _pair(spark, sf_dir, "orders", BEFORE, AFTER)


def _on_orders(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*orders(spark, sf_dir))


def _sides(b: DataFrame, a: DataFrame, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return measure(b).select(F.lit("before").alias("side"), "*").unionByName(measure(a).select(F.lit("after").alias("side"), "*"))


def row_summary(b: DataFrame, a: DataFrame) -> DataFrame:
    r = DiffResult(*[dist.basics(df, [], [], [])["rows"] for df in (b, a)], ())
    return b.sparkSession.createDataFrame([(r.rows_before, r.rows_after, r.row_delta, round(r.row_delta_pct, 4))], "rows_before bigint, rows_after bigint, row_delta bigint, row_delta_pct double")


def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, a = _pair(spark, sf_dir, "events", EVENTS_BEFORE, EVENTS_AFTER)
    return spark.createDataFrame([(f.column, f.severity, f.title) for f in schema_findings(profile(b, a))], "column string, severity string, title string")


def profile_ndv(b: DataFrame, a: DataFrame) -> DataFrame:
    rows = []
    for side, df in (("before", b), ("after", a)):
        n = max(dist.basics(df, [], [], [])["rows"], 1)
        rows += [(side, c["name"], c["n_unique"], round(c["n_unique"] / n, 6)) for c in summaries(df, samples=0)]
    return b.sparkSession.createDataFrame(rows, "side string, column string, ndv bigint, ratio double")


def semantic_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for t in ("customer", "orders", "part", "events"):
        rows += [(t, c, k) for c, k in semantic_types(spark.read.parquet(f"{sf_dir}/{t}.parquet")).items()]
    return spark.createDataFrame(rows, "table string, column string, semantic_type string")


def null_rate_diff(b: DataFrame, a: DataFrame) -> DataFrame:
    x, y = (dist.basics(df, list(COLUMNS), [], []) for df in (b, a))
    rows = []
    for c in COLUMNS:
        found = dist.null_rates(c, (x["rows"], y["rows"]), (x["filled"][c], y["filled"][c]), TIMES)
        rows.append((c, *[round(1 - side["filled"][c] / side["rows"], 4) for side in (x, y)], found[0].severity if found else None))
    return b.sparkSession.createDataFrame(rows, "column string, null_before double, null_after double, severity string")


def mean_shift(b: DataFrame, a: DataFrame) -> DataFrame:
    x, y = (dist.basics(df, [], list(NUMERIC), [])["mean"] for df in (b, a))
    rows = [(c, round(x[c], 4), round(y[c], 4), round(delta, 4), dist.graded(delta, TIMES)) for c in NUMERIC for delta in (dist.mean_delta(x[c], y[c]),)]
    return b.sparkSession.createDataFrame(rows, "column string, mean_before double, mean_after double, delta_pct double, severity string")


def numeric_summary(b: DataFrame, a: DataFrame) -> DataFrame:
    shape, rows = dist.numeric_shapes(b, a, ["o_totalprice"]).first(), []
    for side, df in (("before", b), ("after", a)):
        x = dist.basics(df, [], ["o_totalprice"], [])
        rows.append((side, round(x["mean"]["o_totalprice"], 4), round(x["std"]["o_totalprice"], 4), *[round(shape[f"{q}_{side}"], 4) for q in dist.QUARTILES]))
    return b.sparkSession.createDataFrame(rows, "side string, mean double, std double, " + ", ".join(f"{q} double" for q in dist.QUARTILES))


def ks_statistic(b: DataFrame, a: DataFrame) -> DataFrame:
    return dist.ks_statistics(b, a, list(NUMERIC)).select("column", "n_before", "n_after", F.round("d", 6).alias("d"))


def ks_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, a = _pair(spark, sf_dir, "lineitem", LINES_BEFORE, LINES_AFTER)
    return dist.ks_statistics(b, a, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]).select("column", "n_before", "n_after", F.round("d", 6).alias("d"))


def ks_pvalue(b: DataFrame, a: DataFrame) -> DataFrame:
    rows = [(r["column"], round(r["d"], 6), round(p_value(r["d"], r["n_before"], r["n_after"]), 6)) for r in dist.ks_statistics(b, a, list(NUMERIC)).collect()]
    return b.sparkSession.createDataFrame(rows, "column string, d double, p double")


def new_categories(b: DataFrame, a: DataFrame) -> DataFrame:
    return dist.value_counts(b, a, list(CATEGORY), "string").where(dist.is_new()).select("column", "value", "n_after")


def changed_categories(b: DataFrame, a: DataFrame) -> DataFrame:
    return dist.changed_categories(b, a, list(CATEGORY))


def gone_categories(b: DataFrame, a: DataFrame) -> DataFrame:
    rows = []
    for c, x in dist.category_statistics(b, a, list(CATEGORY), TIMES).items():
        rows += [(c, x["gone"], x["known"], round(x["gone"] / x["known"], 4), f.severity) for f in dist.category_changes(c, x) if "missing_count" in f.metric]
    return b.sparkSession.createDataFrame(rows, "column string, gone bigint, known bigint, gone_ratio double, severity string")


def share_shift(b: DataFrame, a: DataFrame) -> DataFrame:
    found = dist.category_statistics(b, a, list(CATEGORY), 0.01)
    rows = [(f.column, f.metric["value"], f.metric["before"], f.metric["after"], f.severity) for c, x in found.items() for f in dist.category_changes(c, x) if "delta" in f.metric]
    return b.sparkSession.createDataFrame(rows, "column string, value string, share_before double, share_after double, severity string")


def datetime_range(b: DataFrame, a: DataFrame) -> DataFrame:
    x, y = (dist.basics(df, [], [], ["o_orderdate"])["range"]["o_orderdate"] for df in (b, a))
    (f,) = dist.date_range("o_orderdate", x, y)
    return b.sparkSession.createDataFrame([(side, f.metric[f"min_{side}"], f.metric[f"max_{side}"]) for side in ("before", "after")], "side string, first_date string, last_date string")


def key_status_counts(b: DataFrame, a: DataFrame) -> DataFrame:
    return key_counts(key_status(b, a, "o_orderkey"))


def key_duplicates(b: DataFrame, a: DataFrame) -> DataFrame:
    return key_status(b, a, "o_orderkey").where("n_after > 1").select("key", "n_after")


def keys_deleted(b: DataFrame, a: DataFrame) -> DataFrame:
    return key_status(b, a, "o_orderkey").where("key IS NOT NULL AND n_before > 0 AND n_after = 0").select("key")


def keys_added(b: DataFrame, a: DataFrame) -> DataFrame:
    return key_status(b, a, "o_orderkey").where("key IS NOT NULL AND n_before = 0 AND n_after > 0").select("key")


METRICS = {
    "metric_ratio": kpi.Metric("r", "ratio", numerator="o_totalprice", denominator="o_custkey"),
    "metric_rate": kpi.Metric("f", "rate", column="o_orderstatus", match_value="F"),
    "metric_completeness": kpi.Metric("c", "completeness", column="o_totalprice"),
    "metric_staleness": kpi.Metric("s", "staleness", column="o_orderdate", threshold_days=365),
    "metric_custom_gt": kpi.Metric("g", "custom", expression="(df['o_totalprice'] > 300000).mean()"),
    "metric_custom_ne": kpi.Metric("n", "custom", expression="(df['o_orderstatus'] != 'F').mean()"),
}


def _metric(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(b: DataFrame, a: DataFrame) -> DataFrame:
        when = F.lit(AS_OF).cast("timestamp")
        return _sides(b, a, lambda df: df.agg(F.round(kpi.measure(METRICS[name], df, when), 6).alias("value")))

    return _on_orders(run)


#: The metrics with thresholds, so that every rule decides one.
GRADED = tuple(
    replace(METRICS[f"metric_{kind}"], **limits)
    for kind, limits in (
        ("ratio", {"fail_if_above": 1e9, "warn_if_above": 1.0}),
        ("rate", {"fail_if_above": 0.5, "warn_if_above": 0.1}),
        ("completeness", {"fail_if_below": 0.5, "warn_if_below": 0.999}),
        ("staleness", {"fail_if_below": 0.01, "warn_if_delta_pct": 0.5}),
        ("custom_gt", {"fail_if_delta_pct": 5.0, "warn_if_delta_pct": 0.01}),
        ("custom_ne", {"fail_if_delta_pct": 0.1}),
    )
)


def metric_severity(b: DataFrame, a: DataFrame) -> DataFrame:
    found = kpi.metric_findings(b, a, kpi.MetricsConfig("", GRADED), F.lit(AS_OF).cast("timestamp"))
    return b.sparkSession.createDataFrame([(f.metric["name"], f.metric["value_before"], f.metric["value_after"], f.severity) for f in found], "name string, value_before double, value_after double, severity string")


def _lens(scenario: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(k, f.layer, f.column, f.severity) for k, f in enumerate(_diff(spark, sf_dir, scenario).findings)], "seq int, layer string, column string, severity string")

    return run


def _diff(spark: SparkSession, sf_dir: str, scenario: str = "general"):
    b, a = orders(spark, sf_dir)
    return compare(b, a, scenario, metrics=kpi.MetricsConfig("", tuple(METRICS.values())), as_of=F.lit(AS_OF).cast("timestamp"))


def diff_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).measures_df(spark)


def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir, "etl").to_df(spark).groupBy("layer", "severity").agg(F.count("*").alias("n"))


def diff_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(*_pair(spark, sf_dir, "lineitem", LINES_BEFORE, LINES_AFTER)).measures_df(spark)


def diff_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(*_pair(spark, sf_dir, "events", EVENTS_BEFORE, EVENTS_AFTER), scenario="migration").measures_df(spark)


def column_summary(b: DataFrame, a: DataFrame) -> DataFrame:
    return b.sparkSession.createDataFrame([(c["name"], c["dtype"], c["n_unique"], c["null_pct"]) for c in summaries(b, samples=0)], "name string, dtype string, n_unique bigint, null_pct double")


#: Ways of writing a date, by the last digit of the key (Spark's pattern, DuckDB's pattern); 9: no date.
WRITTEN = (("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("yyyy-MM", "%Y-%m"), ("yyyy", "%Y"), ("yyyyMMdd", "%Y%m%d"), ("MM/dd/yyyy", "%m/%d/%Y"), ("dd.MM.yyyy", "%d.%m.%Y"), ("d MMM yyyy", "%-d %b %Y"), ("MM/dd/yyyy h:mm a", "%m/%d/%Y %-I:%M %p"))


def datetime_strings(b: DataFrame, a: DataFrame) -> DataFrame:
    """Lenient parsing of dates that are written as text, in nine ways, and of texts that are none."""
    way = F.pmod("o_orderkey", F.lit(10))
    text = F.coalesce(*[F.when(way == k, F.date_format("o_orderdate", fmt)) for k, (fmt, _) in enumerate(WRITTEN)], F.concat(F.lit("no. "), F.col("o_custkey").cast("string")))
    shown = a.select(way.alias("way"), parsed(text).alias("t"))
    return shown.groupBy("way").agg(F.count("*").alias("n"), F.count("t").alias("parsed"), F.date_format(F.min("t"), "yyyy-MM-dd HH:mm").alias("first"), F.date_format(F.max("t"), "yyyy-MM-dd HH:mm").alias("last"))


def age_in_days(b: DataFrame, a: DataFrame) -> DataFrame:
    days = days_since(F.col("o_orderdate"), F.lit(AS_OF).cast("timestamp"))
    return a.groupBy((F.floor(days / 365)).alias("years")).agg(F.count("*").alias("n"))


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, line) for k, line in enumerate(render.text(_diff(spark, sf_dir)).split("\n"))], "line_no int, line string")


def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(render.html(_diff(spark, sf_dir)),)], "html string")


def report_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(narrative.story(_diff(spark, sf_dir)),)], "story string")


def profile_pair(b: DataFrame, a: DataFrame) -> DataFrame:
    return b.sparkSession.createDataFrame([(p.name, p.semantic_type, p.in_before, p.in_after) for p in profile(b, a)], "column string, semantic_type string, in_before boolean, in_after boolean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    pair = {f.__name__: _on_orders(f) for f in (row_summary, profile_ndv, null_rate_diff, mean_shift, numeric_summary, ks_statistic, ks_pvalue, new_categories, changed_categories, gone_categories, share_shift, datetime_range, key_status_counts, key_duplicates, keys_deleted, keys_added, column_summary, datetime_strings, age_in_days, profile_pair, metric_severity)}
    whole = {"schema_diff": schema_diff, "semantic_types": semantic_classes, "ks_lineitem": ks_lineitem, "diff_findings": diff_findings, "finding_counts": finding_counts, "diff_lineitem": diff_lineitem, "diff_events": diff_events, "report_text": report_text, "report_html": report_html, "report_story": report_story}
    return pair | whole | {n: _metric(n) for n in METRICS} | {f"scenario_lens_{s.replace('-', '')}": _lens(s) for s in lens.SCENARIOS}


#: Metrics in SQL, as aggregates of a side.
_SHARE = "avg(CAST({} AS DOUBLE))"
METRIC_SQL = {
    "metric_ratio": "sum(o_totalprice) / sum(CAST(o_custkey AS DOUBLE))",
    "metric_rate": _SHARE.format("o_orderstatus IS NOT DISTINCT FROM 'F'"),
    "metric_completeness": _SHARE.format("o_totalprice IS NOT NULL"),
    "metric_staleness": _SHARE.format(f"coalesce(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(o_orderdate)) / 86400000000.0) > 365, false)"),
    "metric_custom_gt": _SHARE.format("coalesce(o_totalprice > 300000, false)"),
    "metric_custom_ne": _SHARE.format("o_orderstatus IS DISTINCT FROM 'F'"),
}

# --- the same in SQL ---------------------------------------------------------------------------------------------

_WITH = f"WITH b AS ({BEFORE.format(orders='orders')}), a AS ({AFTER.format(orders='orders')})"


def _each(columns: tuple[str, ...], make: Callable[[str], str]) -> str:
    return " UNION ALL ".join(map(make, columns))


def _two(measure: str) -> str:
    return f"{_WITH} SELECT 'before' AS side, {measure} FROM b UNION ALL SELECT 'after' AS side, {measure} FROM a"


_CATEGORIES = "c AS (" + _each(CATEGORY, lambda c: f"SELECT '{c}' AS col, v AS value, CAST(sum(is_b) AS BIGINT) AS n_before, CAST(sum(is_a) AS BIGINT) AS n_after FROM (SELECT {c} AS v, 1 AS is_b, 0 AS is_a FROM b UNION ALL SELECT {c}, 0, 1 FROM a) WHERE v IS NOT NULL GROUP BY v") + ")"
_KEYS = "k AS (SELECT o_orderkey AS key, CAST(sum(is_b) AS BIGINT) AS n_before, CAST(sum(is_a) AS BIGINT) AS n_after FROM (SELECT o_orderkey, 1 AS is_b, 0 AS is_a FROM b UNION ALL SELECT o_orderkey, 0, 1 FROM a) GROUP BY o_orderkey)"


def _ks(before: str, after: str, columns: tuple[str, ...], places: int = 6) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v, {b} AS is_b, {1 - b} AS is_a FROM ({s}) WHERE {c} IS NOT NULL" for c in columns for b, s in ((1, before), (0, after)))
    return (
        f"WITH l AS ({long}), g AS (SELECT col, v, sum(is_b) AS nb, sum(is_a) AS na FROM l GROUP BY col, v), "
        "r AS (SELECT col, sum(nb) OVER w AS cb, sum(na) OVER w AS ca, sum(nb) OVER (PARTITION BY col) AS tb, sum(na) OVER (PARTITION BY col) AS ta FROM g WINDOW w AS (PARTITION BY col ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
        f'SELECT col AS "column", CAST(max(tb) AS BIGINT) AS n_before, CAST(max(ta) AS BIGINT) AS n_after, round(max(abs(CAST(cb AS DOUBLE) / tb - CAST(ca AS DOUBLE) / ta)), {places}) AS d FROM r GROUP BY col'
    )


def _semantic(table: str, columns: dict[str, str]) -> str:
    """columns: name -> kind (int, number, text, instant), by the schema."""

    def one(c: str) -> str:
        kind = columns[c]
        ratio = f"(SELECT CAST(count(DISTINCT {c}) AS DOUBLE) / greatest(count(*), 1) FROM {table})"
        rule = {"instant": "'datetime'", "number": "'numeric'", "int": f"CASE WHEN {ratio} > 0.95 THEN 'id' ELSE 'numeric' END", "text": f"CASE WHEN {ratio} < 0.05 THEN 'category' WHEN {ratio} > 0.5 THEN 'text' ELSE 'category' END"}[kind]
        return f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", {rule} AS semantic_type"

    return _each(tuple(columns), one)


_SCHEMAS = {
    "customer": {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "number", "c_mktsegment": "text"},
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "instant", "o_orderpriority": "text"},
    "part": {"p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int", "p_retailprice": "number"},
    "events": {"event_id": "int", "ts": "instant", "user_id": "int", "event_type": "text", "value": "number", "props": "text"},
}


_ORDERS = oracles.Pair(
    BEFORE.format(orders="orders"),
    AFTER.format(orders="orders"),
    {"o_orderkey": "id", "o_custkey": "numeric", "o_orderstatus": "category", "o_totalprice": "numeric", "o_orderdate": "datetime", "o_orderpriority": "category"},
    "o_orderkey",
    [(m, METRIC_SQL[name]) for name, m in METRICS.items()],
)
_LINES = oracles.Pair(
    LINES_BEFORE.format(lineitem="lineitem"),
    LINES_AFTER.format(lineitem="lineitem"),
    {c: "numeric" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")} | {"l_returnflag": "category", "l_linestatus": "category", "l_shipdate": "datetime"},
)
_EVENTS = oracles.Pair(EVENTS_BEFORE.format(events="events"), EVENTS_AFTER.format(events="events"), {"event_id": "id", "ts": "datetime", "user_id": "numeric", "event_type": "category", "value": "other"}, "event_id")


def oracle_sql() -> dict[str, str]:
    metric = {name: _two(f"round({sql}, 6) AS value") for name, sql in METRIC_SQL.items()}
    return {
        "row_summary": f"{_WITH}, n AS (SELECT (SELECT count(*) FROM b) AS rows_before, (SELECT count(*) FROM a) AS rows_after) SELECT rows_before, rows_after, rows_after - rows_before AS row_delta, round(CAST(rows_after - rows_before AS DOUBLE) / greatest(rows_before, 1), 4) AS row_delta_pct FROM n",
        "schema_diff": f'SELECT col AS "column", severity, title FROM ({_EVENTS.schema()})',
        "profile_ndv": f"{_WITH} " + " UNION ALL ".join(f"SELECT '{s}' AS side, '{c}' AS \"column\", count(DISTINCT {c}) AS ndv, round(CAST(count(DISTINCT {c}) AS DOUBLE) / greatest(count(*), 1), 6) AS ratio FROM {t}" for s, t in (("before", "b"), ("after", "a")) for c in COLUMNS),
        "semantic_types": " UNION ALL ".join(_semantic(t, c) for t, c in _SCHEMAS.items()),
        "null_rate_diff": f"{_WITH}, r AS (" + _each(COLUMNS, lambda c: f"SELECT '{c}' AS col, (SELECT avg(CAST({c} IS NULL AS DOUBLE)) FROM b) AS x, (SELECT avg(CAST({c} IS NULL AS DOUBLE)) FROM a) AS y") + ") SELECT col AS \"column\", round(x, 4) AS null_before, round(y, 4) AS null_after, CASE WHEN abs(y - x) > 0.2 THEN 'FAIL' WHEN abs(y - x) > 0.1 THEN 'WARN' END AS severity FROM r",
        "mean_shift": f"{_WITH}, r AS (" + _each(NUMERIC, lambda c: f"SELECT '{c}' AS col, (SELECT avg(CAST({c} AS DOUBLE)) FROM b) AS x, (SELECT avg(CAST({c} AS DOUBLE)) FROM a) AS y") + ") SELECT col AS \"column\", round(x, 4) AS mean_before, round(y, 4) AS mean_after, round((y - x) / abs(x), 4) AS delta_pct, CASE WHEN abs((y - x) / x) > 0.2 THEN 'FAIL' WHEN abs((y - x) / x) > 0.1 THEN 'WARN' END AS severity FROM r",
        "numeric_summary": _two(", ".join(f"{oracles.rounded(sql)} AS {name}" for name, sql in {"mean": "avg(o_totalprice)", "median": "quantile_cont(o_totalprice, 0.5)", "std": "stddev_samp(o_totalprice)", "p25": "quantile_cont(o_totalprice, 0.25)", "p75": "quantile_cont(o_totalprice, 0.75)"}.items())),
        "ks_statistic": _ks(BEFORE.format(orders="orders"), AFTER.format(orders="orders"), NUMERIC),
        "ks_lineitem": _ks(LINES_BEFORE.format(lineitem="lineitem"), LINES_AFTER.format(lineitem="lineitem"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")),
        "new_categories": f'{_WITH}, {_CATEGORIES} SELECT col AS "column", value, n_after FROM c WHERE n_before = 0',
        "gone_categories": f"{_WITH}, {_CATEGORIES}, g AS (SELECT col, CAST(sum(CASE WHEN n_before > 0 AND n_after = 0 THEN 1 ELSE 0 END) AS BIGINT) AS gone, CAST(sum(CASE WHEN n_before > 0 THEN 1 ELSE 0 END) AS BIGINT) AS known FROM c GROUP BY col) SELECT col AS \"column\", gone, known, round(CAST(gone AS DOUBLE) / greatest(known, 1), 4) AS gone_ratio, CASE WHEN CAST(gone AS DOUBLE) / greatest(known, 1) > 0.5 THEN 'FAIL' ELSE 'WARN' END AS severity FROM g WHERE gone > 0",
        "share_shift": f"{_WITH}, {_CATEGORIES}, t AS (SELECT *, sum(n_before) OVER (PARTITION BY col) AS tb, sum(n_after) OVER (PARTITION BY col) AS ta FROM c), s AS (SELECT col, value, n_before, n_after, CAST(n_before AS DOUBLE) / tb AS sb, CAST(n_after AS DOUBLE) / ta AS sa FROM t) SELECT col AS \"column\", value, round(sb, 4) AS share_before, round(sa, 4) AS share_after, 'WARN' AS severity FROM s WHERE n_before > 0 AND n_after > 0 AND abs(sa - sb) > 0.01",
        "changed_categories": f"{_WITH}, {_CATEGORIES} SELECT col AS \"column\", CASE WHEN n_before = 0 THEN 'new' ELSE 'gone' END AS kind, value FROM c WHERE n_before = 0 OR n_after = 0",
        "ks_pvalue": f'SELECT "column", round(d, 6) AS d, round({oracles.p_value("d", "n_before", "n_after")}, 6) AS p FROM ({_ks(BEFORE.format(orders="orders"), AFTER.format(orders="orders"), NUMERIC, 15)})',
        "profile_pair": f'{_WITH} SELECT "column", semantic_type, true AS in_before, true AS in_after FROM ({_semantic("b", _SCHEMAS["orders"])})',
        "datetime_range": _two("CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_date, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_date"),
        "key_status_counts": f"{_WITH}, {_KEYS} SELECT CAST(sum(greatest(n_after - 1, 0)) AS BIGINT) AS duplicates, count(CASE WHEN n_before > 0 AND n_after = 0 THEN 1 END) AS deleted, count(CASE WHEN n_before = 0 AND n_after > 0 THEN 1 END) AS added, count(CASE WHEN n_before > 0 THEN 1 END) AS before_keys FROM k",
        "key_duplicates": f"{_WITH}, {_KEYS} SELECT key, n_after FROM k WHERE n_after > 1",
        "keys_deleted": f"{_WITH} SELECT DISTINCT o_orderkey AS key FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.o_orderkey = b.o_orderkey)",
        "keys_added": f"{_WITH} SELECT DISTINCT o_orderkey AS key FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.o_orderkey = b.o_orderkey)",
        "column_summary": f"{_WITH} " + _each(COLUMNS, lambda c: f"SELECT '{c}' AS name, {oracles.spark_type(f'any_value(typeof({c}))')} AS dtype, count(DISTINCT {c}) AS n_unique, round(1 - CAST(count({c}) AS DOUBLE) / count(*), 3) AS null_pct FROM b"),
        "datetime_strings": f"{_WITH}, s AS (SELECT o_orderkey % 10 AS way, CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN strptime(strftime(o_orderdate, '{fmt}'), '{fmt}')" for k, (_, fmt) in enumerate(WRITTEN)) + " END AS t FROM a) SELECT way, count(*) AS n, count(t) AS parsed, strftime(min(t), '%Y-%m-%d %H:%M') AS first, strftime(max(t), '%Y-%m-%d %H:%M') AS last FROM s GROUP BY way",
        "age_in_days": f"{_WITH} SELECT CAST(floor(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(o_orderdate)) / 86400000000.0) / 365) AS BIGINT) AS years, count(*) AS n FROM a GROUP BY 1",
        "metric_severity": oracles.metric_severity(_WITH, [(m, METRIC_SQL[name]) for name, m in zip(METRICS, GRADED, strict=True)]),
        "diff_findings": _ORDERS.measures(),
        "diff_lineitem": _LINES.measures(),
        "diff_events": _EVENTS.measures("migration"),
        "finding_counts": _ORDERS.counts("etl"),
    } | metric | {f"scenario_lens_{s.replace('-', '')}": _ORDERS.severities(s) for s in lens.SCENARIOS}
