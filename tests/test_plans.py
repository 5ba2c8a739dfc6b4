"""What the plans of some queries must look like."""

import re

import pytest

from quillstone.plans import registry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name, columns", [
    ("run_agreement", {"evaluation_id", "run", "retrieval_source", "canonical_chunk_id", "score"}), ("reversed_pages", {"chunk_id", "page_start", "page_end"}),
    ("exact_copies", {"doc_id", "text", "source"}), ("visible_per_scope", {"source_id", "visibility", "specialist_scope", "document_source_id"})])
def test_scans_read_only_what_is_used(spark, name, columns):
    read = {c for s in re.findall(r"ReadSchema: struct<([^\n]*)>", plan(spark, name)) for c in re.findall(r"(\w+):", s)}
    assert read and read <= columns


@pytest.mark.parametrize("name, pushed", [("reversed_pages", "IsNotNull(page_start)"), ("pricing_summary", "l_shipdate"), ("vector_topk", "IsNotNull(chunk_id)"), ("broken_fragment_runs", "EqualTo(is_fragment,true)")])
def test_filters_reach_the_scan(spark, name, pushed):
    assert any(pushed in f for f in re.findall(r"PushedFilters: \[([^\n]*)\]", plan(spark, name)))


@pytest.mark.parametrize("name", ["ranking_metrics", "rank_fusion", "run_agreement"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_nested_loops_and_no_cartesian_products(spark, name):
    if name.startswith("stream_"):
        pytest.skip("runs a stream")
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
