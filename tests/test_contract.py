"""Every query against its SQL on the small tables, also with all groups cut up, and plan checks."""

import re

import pytest

import __spark_entry__ as contract
import check_oracle
from inkwell.plans.registry import ORACLE, QUERIES
from tests.plan_nodes import exchanges, scans

SF = "/root/testdata/sf0.001"
ORDERED = [
    "merge_chunks", "combine_files", "pages_to_documents", "blocks_to_documents", "status_changes", "retry_outcomes",
    "request_cost_running", "dedup_links", "dedup_index_lists", "expand_results", "table_to_csv",
]


@pytest.fixture(scope="module")
def duck():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    assert check_oracle.compare(spark, duck, name, SF) is None


@pytest.mark.parametrize("name", ORDERED)
def test_query_agrees_when_groups_are_cut(spark, duck, small_limits, name):
    assert check_oracle.compare(spark, duck, name, SF) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())


def test_flagship(spark):
    assert contract.entry(spark).count() == 7


def plan_of(spark, name):
    return contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


NO_PYTHON = [n for n in QUERIES if n != "document_responses"]


@pytest.mark.parametrize("name", [n for n in NO_PYTHON if not n.startswith("stream_")])
def test_plan(spark, name):
    plan = plan_of(spark, name)
    assert not re.search(r"EvalPython|InPandas|InArrow|CartesianProduct", plan)
    # The only joins without a key are with one-row totals.
    for side in re.findall(r"BroadcastNestedLoopJoin[^\n]*", plan):
        assert "Cross" in side


def test_scans_are_pruned(spark):
    assert re.search(r"ReadSchema: struct<doc_id:bigint>", plan_of(spark, "assign_batches_by_key"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan_of(spark, "recent_events")
    assert "text" not in re.findall(r"ReadSchema: \S+", plan_of(spark, "filter_batches"))[0]


ONCE = ["merge_chunks", "combine_files", "conversation_log", "pages_to_documents", "blocks_to_documents", "table_to_csv"]


@pytest.mark.parametrize("name", ONCE)
def test_texts_move_once(spark, name):
    got = contract.queries()[name](spark, SF)
    assert len(exchanges(got, "_item")) == 1 and not exchanges(got, "buf") and not exchanges(got, "text")
    assert len(scans(got, "c_name" if name == "table_to_csv" else "text")) <= 2


@pytest.mark.parametrize("name", ONCE)
def test_texts_move_once_when_groups_are_cut(spark, small_limits, name):
    got = contract.queries()[name](spark, SF)
    # Border segments are put together from their parts; whole texts do not move again.
    assert len(exchanges(got, "_item")) == 1 and len(exchanges(got, "buf")) <= 1 and not exchanges(got, "text")
    assert len(scans(got, "c_name" if name == "table_to_csv" else "text")) <= 2
