"""Physical plans: no pairwise joins, filters and columns reach the scan, limits go down."""

from __future__ import annotations

import pytest

import workload

FOLDER = "/root/testdata/sf0.001"
ITERATIVE = {
    "leiden_membership",
    "setcover_clusters",
    "tsne_layout",
    "umap_layout",
    "score_table_pca",
    "structure_pair_scores",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(workload.QUERIES) - ITERATIVE))
def test_no_pairwise_joins_and_no_row_udfs(spark, name):
    plan = plan_of(workload.QUERIES[name](spark, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan


def test_pushdown_and_pruning(spark):
    plan = plan_of(workload.QUERIES["resume_pending"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in plan
    plan = plan_of(workload.QUERIES["hit_union_distinct"](spark, FOLDER))
    assert "ReadSchema: struct<o_custkey:bigint>" in plan
    plan = plan_of(workload.QUERIES["annotation_topn"](spark, FOLDER))
    assert "WindowGroupLimit" in plan
    plan = plan_of(workload.QUERIES["hit_extract_cap"](spark, FOLDER))
    assert "TakeOrderedAndProject" in plan


def test_one_shuffle_for_many_tables(spark):
    plan = plan_of(workload.QUERIES["feature_outer_merge"](spark, FOLDER))
    # One for the line aggregate, one for the fold of all tables.
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_key_scores_are_a_projection(spark):
    assert "Exchange" not in plan_of(workload.QUERIES["key_vs_all"](spark, FOLDER))
