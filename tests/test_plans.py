"""What the plans of headline queries must and must not hold."""

import os
import re

import pytest

from loresmith import catalogue

catalogue.load()

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plan(spark, name):
    return catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize(
    "name",
    "conv_validate conv_render_prompt cross_split_owner dataset_coverage outcome_tally generation_coverage paired_difference budget_gate failure_streak greedy_packing text_word_inventory marker_render expr_eval cond_filter scene_ids seeded_pick".split(),
)
def test_hot_paths_stay_in_the_engine(spark, name):
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


@pytest.mark.parametrize(
    ("name", "columns"),
    [("outcome_tally", "doc_id:bigint,quality:int,toxic:int"), ("dataset_coverage", "doc_id:bigint,lang:string,n_chars:bigint"), ("split_assign", "doc_id:bigint"), ("ledger_spend", "event_id:bigint,user_id:bigint,value:double"), ("greedy_packing", "doc_id:bigint,source:string,n_chars:bigint")],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(spark, name)


@pytest.mark.parametrize(("name", "pushed"), [("vec_eligible_topk", "Not(In(label"), ("greedy_packing", "LessThanOrEqual(n_chars,8192)"), ("disagreements", "Not(EqualTo(event_type,error))")])
def test_filters_reach_the_scan(spark, name, pushed):
    text = plan(spark, name)
    assert pushed in text or (name == "vec_eligible_topk" and "PushedFilters" in text)


@pytest.mark.parametrize("name", ["vec_topk_passages", "vec_topk_scenes", "vec_query_plan"])
def test_vectors_are_scored_once_by_arrow_batches(spark, name):
    text = plan(spark, name)
    assert len(re.findall(r"^\(\d+\) (?:ArrowEvalPython|MapInArrow)", text, re.MULTILINE)) == 1 and not re.search("BatchEvalPython|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_top_k_is_cut_before_it_is_shuffled(spark):
    for name in ("vec_topk_passages", "vec_query_plan"):
        text = plan(spark, name)
        assert re.search("WindowGroupLimit|TakeOrderedAndProject|MapInArrow|MapInPandas", text) and "CartesianProduct" not in text


@pytest.mark.parametrize(("name", "most"), [("vec_topk_scenes", 2), ("outcome_tally", 1), ("conv_validate", 1), ("dataset_coverage", 1), ("ledger_spend", 3), ("split_assign", 0), ("cond_filter", 0)])
def test_shuffles_are_few(spark, name, most):
    assert len(re.findall(r"^\(\d+\) Exchange", plan(spark, name), re.MULTILINE)) <= most
