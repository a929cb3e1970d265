"""Every registered query against its SQL form on the smallest data set."""

import pytest

import __spark_entry__ as contract
from tablewright.queries import load
from tests.oracle import compare, duck

SF_DIR = "/root/testdata/sf0.001"
REGISTRY = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", [n for n, r in REGISTRY.items() if r.sql])
def test_query_equals_sql(spark, con, name):
    difference, _, _ = compare(spark, con, REGISTRY[name].run, REGISTRY[name].sql, SF_DIR)
    assert difference == ""


def test_contract(spark):
    assert contract.entry(spark).columns == ["example_id", "segment", "answer", "status"]
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_row_local_queries_stay_in_the_jvm(spark):
    for name in ["sketch_answers", "linearize_tables", "denotation_accuracy", "columns_by_vote"]:
        plan = REGISTRY[name].run(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


def test_plan_documents_are_read_without_shuffle_or_second_pass(spark):
    plans = REGISTRY["plan_shred"].run(spark, SF_DIR)
    plan = plans._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("Exchange hashpartitioning") == 0


@pytest.mark.parametrize("name", ["sketch_answers", "sketch_answers_large", "typed_cells", "dag_chain_layers", "plan_nodes_sql"])
def test_building_a_query_runs_few_jobs(spark, name):
    context = spark.sparkContext
    context.setJobGroup(f"build-{name}", name)
    try:
        REGISTRY[name].run(spark, SF_DIR)
        # Files and schemas are looked at by Spark itself; beyond that at most a count of the largest group.
        assert len(context.statusTracker().getJobIdsForGroup(f"build-{name}")) <= 6
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
