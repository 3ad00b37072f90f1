import sys

import pytest
from oracle import answer, cells

from tidemark.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    if name == "ks_pvalue":  # its SQL holds for more than 10,000 rows
        sf_dir = "/root/testdata/sf0.01"
    found = catalog.queries()[name](spark, sf_dir).toPandas()
    assert cells(found) == cells(answer(SQL[name], sf_dir))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry_point_without_corpus_operators(monkeypatch):
    import __spark_entry__

    for name in ("corpus_pipeline", "tidemark.llm"):
        with monkeypatch.context() as m:
            m.setitem(sys.modules, name, None)  # importing it raises ImportError
            if name == "tidemark.llm":
                for module in [k for k in sys.modules if k.startswith("tidemark.llm.") or k == "corpus_pipeline"]:
                    m.delitem(sys.modules, module)
            assert set(__spark_entry__.queries()) == set(catalog.queries()) and set(__spark_entry__.oracle_sql()) == set(SQL)


def test_keys_are_shuffled_once(spark, sf_dir):
    from tidemark.operators.integrity import key_status, key_summary

    b, a = catalog.orders(spark, sf_dir)
    plan = key_summary(key_status(b, a, "o_orderkey"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    # keys, and then a row a bucket and task
    assert plan.count("Exchange hashpartitioning(family") + plan.count("Exchange hashpartitioning(key") == 1 and plan.count("Exchange") == 2


def test_entry_point_names(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert set(catalog.queries()) <= set(names)
