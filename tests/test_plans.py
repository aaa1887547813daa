"""Plan-shape checks: bounded plans, no shuffle in the text pipeline, pruned scans."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_small(spark):
    # an expression used twice and inlined by a rewrite would multiply the plan
    for name in ["render_html", "pdf_paragraphs", "assemble_report", "pure_html", "paragraphs", "header_fields",
                 "main_slice", "index_parse", "term_select"]:
        # (the constant table of character references is left out of the count)
        plan = re.sub(r"(?s)\[\x01.{1000,}?\x01\]", "[table]", _optimized(E.queries()[name](spark, SF)))
        plan = re.sub(r"[^\x20-\x7e]+", "", plan)
        assert len(plan) < 100_000, name


def test_filter_on_page_column_stays_linear(spark):
    from quillspark.plans.jobs import convert_to_html
    from quillspark.plans import bridge as B
    r = convert_to_html(B.view(spark, SF, "submissions"), "t")
    assert len(_optimized(r.where(F.col("html").isNotNull()))) < 40 * len(_optimized(r))


def test_text_pipeline_has_no_shuffle(spark):
    # operators add no exchange; a tiny single-row-group source may be rebalanced once (REPARTITION_BY_NUM)
    for name in ["assemble_report", "split_sections", "clean_section", "render_html", "paragraphs", "header_map"]:
        plan = _physical(E.queries()[name](spark, SF))
        assert "ENSURE_REQUIREMENTS" not in plan, name
        assert plan.count("Exchange") <= 1, name


def test_scan_reads_only_needed_columns(spark):
    plan = _physical(E.queries()["latest_filings"](spark, SF))
    assert "o_totalprice" not in plan and "o_orderstatus" not in plan


def test_top_n_per_company_is_a_group_limit(spark):
    df = E.queries()["latest_filings"](spark, SF)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString() or \
        "WindowGroupLimit" in _optimized(df)


def test_per_filing_operators_reuse_the_bridge_shuffle(spark):
    for name in ["main_document", "role_counts", "ordered_documents"]:
        plan = _physical(E.queries()[name](spark, SF))
        assert plan.count("ENSURE_REQUIREMENTS") <= 1, name
