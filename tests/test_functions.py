import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import kolmogorov
from tidemark.functions.expressions import UnsupportedExpression, aggregate
from tidemark.functions.timestamps import days_since, parsed

ACCEPTED = ["2024-01-01", "2024-01-01T00:00:00Z", "2024-01", "20240101", "2023", "13.02.2024", "5 Jan 2024", "Mon, 01 Jan 2024 00:00:00 GMT", "01/02/2024 03:04 PM", "2024-01-01 10:11:12.5"]
REJECTED = ["10001", "94105", "202401", "1", "1.5", "A1", "Jan 5", "may", "9999", "12345678", ""]


def test_timestamp_shapes(spark):
    rows = spark.createDataFrame([(x,) for x in ACCEPTED + REJECTED], "s string").select("s", parsed(F.col("s")).isNotNull().alias("ok")).collect()
    assert {r["s"] for r in rows if r["ok"]} == set(ACCEPTED)


def test_days_are_floored(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 12:00:00' AS a, timestamp'2024-01-11 06:00:00' AS b, timestamp'2024-01-11 00:00:00' AS now")
    assert tuple(df.select(days_since(F.col("a"), F.col("now")), days_since(F.col("b"), F.col("now"))).first()) == (9, -1)


@pytest.mark.parametrize(("m", "n", "d", "p"), [(5, 5, 3 / 5, 0.357142857), (5, 7, 20 / 35, 0.237373737), (6, 8, 12 / 24, 0.301698302), (5, 9, 25 / 45, 0.225774226)])
def test_exact_p(m, n, d, p):
    assert kolmogorov.exact_p(d, m, n) == pytest.approx(p, abs=1e-8)
    hits = paths = 0
    for ups in combinations(range(m + n), m):
        i = j = 0
        worst = 0.0
        for k in range(m + n):
            i, j = (i + 1, j) if k in ups else (i, j + 1)
            worst = max(worst, abs(i / m - j / n))
        paths += 1
        hits += worst >= d - 1e-12
    assert hits / paths == pytest.approx(p, abs=1e-8)


def test_one_sample_cdf():
    assert kolmogorov.one_sample_cdf(10, 0.274) == pytest.approx(0.6284796154565, abs=1e-9)


def test_p_value_of_large_samples():
    assert kolmogorov.p_value(0.2, 20_000, 20_000) == pytest.approx(0, abs=1e-12)
    assert 0 < kolmogorov.p_value(0.05, 20_000, 700) < 1


def test_expressions(spark):
    df = spark.createDataFrame([("free", 1.0), (None, 2.0), ("pro", None)], "plan string, x double")
    value = lambda text: df.agg(aggregate(text, df.columns)).first()[0]
    assert value("(df['plan'] != 'free').mean()") == pytest.approx(2 / 3)
    assert value("(df['plan'] == 'free').mean()") == pytest.approx(1 / 3)
    assert value("(df['x'] > 1).mean()") == pytest.approx(1 / 3)
    assert value("df['x'].sum() / len(df)") == pytest.approx(1.0)
    assert value("(df['plan'].isin(['free', 'pro']) & df['x'].notna()).sum()") == 1.0
    assert value("sum(x) / count(*)") == pytest.approx(1.0)
    assert math.isclose(value("df['x'].std()"), 0.7071067811865476)
    for bad in ("__import__('os').system('true') + len(df)", "df.to_csv('x')", "df['nope'].mean()"):
        with pytest.raises(UnsupportedExpression):
            aggregate(bad, df.columns)
