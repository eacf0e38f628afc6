"""Physical plans: no products of data, nested loops only with one-row or dimension tables, Python only where it is meant."""

import re

import pytest

from palimpsest.plans import catalog

QUERIES = {k: f for k, f in catalog.queries().items() if not k.startswith("stream_")}
#: Queries that join an aggregate of one row, or a grid of dimensions.
LOOPS = {
    "apportion_largest_remainder", "audit_self_check", "baseline_report", "holdout_min_targets", "pretrain_records", "project_plan", "retention_cells", "retention_extremes",
    "retention_slopes", "retention_summary", "score_panel", "stage_assignment", "upsample_cyclic",
}
PYTHON = {"answer_fuzzy", "answer_scores", "answer_score_panel", "golden_scores", "fact_clusters", "greedy_chunks", "pretrain_records", "recovered_turns", "strict_answers"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert name in LOOPS or "BroadcastNestedLoopJoin" not in plan
    assert name in PYTHON or not re.search(r"ArrowEvalPython|BatchEvalPython|InPandas|MapInArrow", plan)


def test_one_shuffle_suffices(spark, folder):
    plan = lambda n: QUERIES[n](spark, folder)._jdf.queryExecution().executedPlan().toString()
    for name in ("longest_gap", "sliding_chunks", "forgetting_summary", "lead_gaps", "event_runs", "keyword_window"):
        assert len(re.findall(r"Exchange hashpartitioning", plan(name))) == 1, name
    assert re.search(r"ReadSchema: struct<[^>]*o_totalprice[^>]*>", plan("forgetting_summary")) and "o_orderkey" in plan("forgetting_summary")


def test_filters_and_columns_reach_the_scan(spark, folder):
    plan = QUERIES["resume_anti"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "l_comment" not in plan
