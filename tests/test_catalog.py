"""Every registered query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    message, rows, _, _ = compare(spark, con, SF_DIR, QUERIES[name], SQL[name])
    assert message is None or (message == "no rows" and name in ("search_filter_exact",)), message


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "city"


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["similar_jobs", "market_reference", "top_skills", "skill_gap", "company_tier", "market_summary",
                                  "salary_histogram", "salary_percentile_rank", "insert_if_absent", "clean_jobs"])
def test_plan_has_no_pairwise_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in ("NestedLoop", "Cartesian", "EvalPython") if bad in plan]


def test_hot_keys_are_cut_before_the_shuffle(spark):
    plan = QUERIES["dedup_keep_salary"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
