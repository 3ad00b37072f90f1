import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import kpi
from tidemark.operators.distribution import category_changes, category_statistics, ks_statistics, null_rates, numeric_shapes
from tidemark.operators.profile import ColumnProfile, column_summary, semantic_types
from tidemark.plans import catalog, lens
from tidemark.plans.compare import compare, compute_diff
from tidemark.plans.findings import DiffResult, Finding
from tidemark.sinks import narrative, render


def found(result):
    return {(f.layer, f.column, f.severity, f.title.split(":")[0].split(" in '")[0]) for f in result.findings}


def test_orders_pair(spark):
    b, a = catalog.orders(spark, "/root/testdata/sf0.01")
    r = compare(b, a)
    assert (r.rows_before, r.rows_after, r.summary_severity) == (14250, 11643, "FAIL")
    assert found(r) == {
        ("integrity", "o_orderkey", "FAIL", "Primary key duplicates"),
        ("integrity", "o_orderkey", "FAIL", "3,455 key(s) deleted from 'o_orderkey' (24.2% of original)"),
        ("integrity", "o_orderkey", "INFO", "603 new key(s)"),
        ("distribution", "o_totalprice", "WARN", "Null rate increased"),
        ("distribution", "o_totalprice", "WARN", "Mean shifted"),
        ("distribution", "o_totalprice", "WARN", "Distribution shape shifted"),
        ("distribution", "o_orderstatus", "INFO", "New categories"),
        ("distribution", "o_orderstatus", "WARN", "'o_orderstatus=F' share grew"),
        ("distribution", "o_orderpriority", "WARN", "Categories disappeared from 'o_orderpriority'"),
        ("distribution", "o_orderdate", "INFO", "Date range changed"),
    }
    mean = next(f.metric for f in r.findings if f.title.startswith("Mean"))
    assert (mean["mean_before"], mean["mean_after"]) == (250290.1056, 290407.6939)
    json.loads(r.to_json())
    assert "Primary key duplicates" in render.html(r) and "FAIL" in render.text(r) and narrative.story(r)


def test_same_table_has_no_findings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert compute_diff(df, df).findings == ()


def test_types_and_nested_columns_do_not_crash(spark):
    b = spark.createDataFrame([(k, k, [k], k % 2 == 0, None) for k in range(20)], "k bigint, x bigint, arr array<bigint>, flag boolean, none string")
    a = spark.createDataFrame([(str(k), f"v{k}", [k], True, None) for k in range(20)], "k string, x string, arr array<bigint>, flag boolean, none string")
    r = compute_diff(b, a, key="k")
    titles = [f.title for f in r.findings]
    assert "Type changed: 'x' (bigint → string)" in titles
    assert any(t.startswith("20 key(s) deleted") for t in titles) and any(t.startswith("20 new key(s)") for t in titles)
    assert any(t.startswith("Mean shifted: 'flag'") for t in titles)


def test_empty_side_has_no_null_noise(spark):
    b = spark.createDataFrame([(1, "a")], "k bigint, s string")
    r = compute_diff(b, b.limit(0))
    assert not [f for f in r.findings if f.title.startswith("Null rate")]
    assert r.rows_after == 0


def test_duplicate_keys_count_nulls(spark):
    rows = [(1,), (1,), (1,), (2,), (None,), (None,), (None,)]
    df = spark.createDataFrame(rows, "k bigint")
    f = next(f for f in compute_diff(df, df, key="k").findings if f.layer == "integrity")
    assert f.metric["duplicate_count"] == 4


def test_dates_in_part_of_a_column(spark):
    """Rows beyond the sample decide where the sample is not clear."""
    mixed = spark.range(4000).selectExpr("CASE WHEN id % 2 = 0 OR id >= 1000 THEN '2024-01-02' ELSE 'x' END AS mostly", "CASE WHEN id % 4 > 0 AND id < 1000 THEN '2024-01-02' ELSE concat('w', id % 30) END AS hardly", "CASE WHEN id < 1000 THEN NULL ELSE '3.4.2024' END AS late").coalesce(1)
    assert semantic_types(mixed) == {"mostly": "datetime", "hardly": "category", "late": "datetime"}


def test_column_summary_samples_are_stable(spark):
    df = spark.range(300).selectExpr("id % 40 AS n", "concat('v', id) AS s", "array(id) AS arr")
    some, same = column_summary(df), column_summary(df.repartition(7))
    assert some == same and len(some[0]["sample"]) == 5 and some[2]["sample"] == [] and some[1]["n_unique"] == 300


@pytest.mark.parametrize("buckets", [2, 3, 128, 1000])
def test_quantiles(spark, buckets):
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "x double")
    r = numeric_shapes(frame((1, 2, 4, 8, 9, 11)), frame((5, 5, 5)), ["x"], buckets).first()
    assert (r["p25_before"], r["median_before"], r["p75_before"]) == (2.5, 6.0, 8.75) and r["median_after"] == 5.0


def test_many_categories_stay_bounded(spark):
    b = spark.range(3000).selectExpr("CAST(id AS STRING) AS c")
    a = spark.range(1500, 6000).selectExpr("CAST(id AS STRING) AS c")
    x = category_statistics(b, a, ["c"], 0.1)["c"]
    assert (x["new"], x["gone"], x["known"], len(x["new_values"]), len(x["gone_values"]), x["moved"]) == (3000, 1500, 3000, 1000, 1000, [])
    new, gone = category_changes("c", x)
    assert (new.severity, gone.severity, new.metric["new_count"], gone.metric["missing_count"]) == ("INFO", "WARN", 3000, 1500)
    assert new.title.endswith("and 2,000 more") and gone.title.endswith("and 500 more")
    # all of them are in the result
    r = compute_diff(b.union(b).union(b), a.union(a).union(a), columns=[ColumnProfile("c", "category", "string", "string")])
    assert {tuple(x) for x in r.categories.groupBy("kind").count().collect()} == {("new", 3000), ("gone", 1500)}
    assert {x["value"] for x in r.categories.where("kind = 'gone'").collect()} == {str(k) for k in range(1500)}


def test_threshold_is_strict():
    assert null_rates("c", (4, 4), (4, 3), 0.25) == []
    assert null_rates("c", (4, 4), (4, 1), 0.25)[0].severity == "FAIL"


def test_few_values_and_zero_mean(spark):
    few = spark.createDataFrame([(float(x),) for x in range(4)], "x double")
    far = spark.createDataFrame([(float(x + 100),) for x in range(4)], "x double")
    assert not [f for f in compute_diff(few, far).findings if f.title.startswith(("Mean", "Distribution"))]
    zero = spark.createDataFrame([(float(x),) for x in range(-10, 11)], "x double")
    moved = spark.createDataFrame([(float(x + 50),) for x in range(21)], "x double")
    titles = [f.title for f in compute_diff(zero, moved).findings]
    assert not any(t.startswith("Mean") for t in titles) and any(t.startswith("Distribution shape") for t in titles)


def test_semantic_types(spark):
    rows = [(k, str(k % 3), f"u{k}", "2024-01-01", float(k), f"w{k % 20}") for k in range(100)]
    df = spark.createDataFrame(rows, "n bigint, paid_flag string, words string, day string, x double, `dotted.name` string")
    assert semantic_types(df) == {"n": "id", "paid_flag": "id", "words": "text", "day": "datetime", "x": "numeric", "dotted.name": "category"}


def test_lens():
    assert [lens.adjusted(*x) for x in (("FAIL", "schema", "etl"), ("INFO", "integrity", "ab-test"), ("WARN", "distribution", "migration"), ("WARN", "custom", "etl"), ("WARN", "schema", "other"))] == ["FAIL", "PASS", "INFO", "WARN", "WARN"]
    r = lens.apply(DiffResult(1, 1, (Finding("custom", None, "FAIL", "c", ""), Finding("schema", None, "WARN", "s", ""))), "etl")
    assert [f.title for f in r.findings] == ["s", "c"]


def test_metric_rules(spark):
    first = kpi.Metric("m", "rate", warn_if_above=0.1, fail_if_below=0.9)
    assert kpi.severity(first, 0.5, 0.5) == "WARN" and kpi.severity(kpi.Metric("m", "rate"), 1, 2) == "INFO"
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "s string, x double")
    config = kpi.parse({"business_context": None, "metrics": [{"name": "r", "type": "rate", "column": "s", "match_value": "a"}, {"name": "w", "type": "rate", "column": "s", "match_value": 1}, {"name": "bad", "type": "what"}, {"name": "gone", "type": "completeness", "column": "zzz"}, {"name": "c", "type": "custom", "expression": "df['x'].sum() / 0"}]})
    out = kpi.metric_findings(df, df, config)
    assert [f.metric.get("value_after") for f in out] == [0.5, 0.0, None, None, None]
    assert [f.severity for f in out] == ["INFO", "INFO", "WARN", "WARN", "INFO"]


def test_staleness_counts_missing_dates_in_the_denominator(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 12:00:00'), (CAST(NULL AS timestamp)) t(d)")
    value = lambda **how: df.agg(kpi.measure(kpi.Metric("s", "staleness", column="d", threshold_days=5, **how), df, F.lit("2024-01-11").cast("timestamp"))).first()[0]
    assert value() == 0.5 and value(nulls_stale=True) == 1.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=30), st.lists(st.integers(-5, 5), min_size=1, max_size=30))
def test_ks_equals_brute_force(spark, x, y):
    frame = lambda v: spark.createDataFrame([(float(k),) for k in v], "x double")
    d = ks_statistics(frame(x), frame(y), ["x"], buckets=4).first()["d"]
    share = lambda v, t: sum(k <= t for k in v) / len(v)
    assert d == pytest.approx(max(abs(share(x, t) - share(y, t)) for t in [*x, *y]))


def test_markup_is_escaped():
    assert "<script>" not in render.html(DiffResult(1, 1, (Finding("schema", "x", "WARN", "<script>", "<b>"),)))
