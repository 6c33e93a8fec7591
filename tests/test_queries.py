"""Every registered query against its SQL text, and its plan against pairwise joins."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


def test_registry_is_consistent():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 180


def test_entry(spark):
    df = entry.entry(spark)
    assert {"market", "days_to_next", "n", "mae"} <= set(df.columns)
    assert df.count() > 0


@pytest.mark.parametrize("key", [k for k in QUERIES if k in SQL])
def test_query_equals_sql(spark, con, folder, key):
    plans = []

    def run(s, f):
        df = QUERIES[key](s, f)
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df
    assert compare(spark, con, run, SQL[key], folder) is None
    assert "Join Cross" not in plans[0]


@pytest.mark.parametrize("key", ["j02_prep_pipeline", "j10_tune_grid", "j17_rolling_origin_evaluation"])
def test_fitted_queries_have_rows(spark, folder, key):
    rows = QUERIES[key](spark, folder).collect()
    assert rows
    for r in rows:
        for v in r:
            assert v is None or v == v  # never NaN
