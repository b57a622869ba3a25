import pytest

from mnemolake.plans.oracles import ORACLE_SQL
from mnemolake.plans.queries import QUERIES
from tests.oracle import DATA, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_module():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_metadata_profiles_run_no_python(spark):
    for name in ("profile_compact", "profile_agent", "cosine_topk"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_topk_keeps_a_heap_and_filters_reach_the_scan(spark):
    assert "TakeOrderedAndProject" in QUERIES["cosine_topk"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id,500)" in QUERIES["event_trim_before"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
