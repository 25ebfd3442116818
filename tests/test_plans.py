"""Physical shape: no one-task exchange of table rows and no row-at-a-time Python."""

import pytest

from tablewright.plans import load

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return load()[0][name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "rank_ensemble", "running_best", "metric_issues", "early_stop", "kfold_stratified", "split_stratified", "tfidf_word",
    "resolve_paths", "grade_join", "medal_report", "encode_unseen", "char_positions", "class_distribution",
])
def test_no_single_partition(spark, name):
    plan = plan_of(spark, name)
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


@pytest.mark.parametrize("name", ["tfidf_char", "log_metrics", "array_resample", "quantiles_exact", "sample_fraction"])
def test_no_python(spark, name):
    plan = plan_of(spark, name)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_columns_are_pruned(spark):
    plan = plan_of(spark, "metric_issues_stateless")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan
