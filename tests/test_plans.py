"""Physical plans: no products of tables, only the columns that are needed, filters in the scan, hot windows cut before the shuffle."""

import re

import pytest

from parchline import queries_core as Q

LAZY = ["access_filter_shop", "dedup_assets", "tq_score", "doc_rollup", "page_gates", "worst_pages", "ocr_word_stats", "default_copy_top1", "generation_build", "generation_verify", "orphan_chunks", "copy_documents", "authority_resolve", "outbox_status",
        "job_claim_order", "access_demand_tumbling", "search_badges", "document_details", "text_sample", "trust_rolling30"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_products(spark, data, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(Q.QUERIES[name](spark, data)))


def test_columns_are_pruned(spark, data):
    text = plan(Q.dedup_assets(spark, data))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


@pytest.mark.parametrize("name", ["if_score", "deduction_totals", "grade_distribution", "doc_rollup", "page_gates", "worst_pages", "skew_weighted_median"])
def test_measurements_do_not_read_texts(spark, data, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan(Q.QUERIES[name](spark, data)))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert scans and not any("extracted_text" in x for x in scans)


def test_terms_of_a_query_reach_the_scan_of_the_index(spark, data):
    text = plan(Q.QUERIES["bm25_and"](spark, data))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(term,washers\)", text) and not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)


def test_filters_reach_the_scan(spark, data):
    assert "IsNotNull(text)" in plan(Q.dedup_assets(spark, data))


def test_windows_are_cut_before_the_shuffle(spark, data):
    assert "WindowGroupLimit" in plan(Q.worst_pages(spark, data))
    assert "WindowGroupLimit" in plan(Q.text_sample(spark, data))
