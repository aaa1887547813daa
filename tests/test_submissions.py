"""Submission pipeline: sections, assembly, header map, routing, extraction, slices."""

from pyspark.sql import functions as F

from quillspark.operators import documents as D
from quillspark.operators import sections as S
from quillspark.plans import jobs as J

BODY = "Substantial narrative text. " * 12  # > 200 characters after cleaning


def block(t, text=None, lower=False):
    d, ty, tx = ("document", "type", "text") if lower else ("DOCUMENT", "TYPE", "TEXT")
    inner = f"<{ty}>{t}\n<SEQUENCE>1\n" + (f"<{tx}>\n{text}\n</{tx}>\n" if text is not None else "")
    return f"<{d}>\n{inner}</{d}>\n"


HEADER = ("<SEC-HEADER>\nACCESSION NUMBER:\t0000000001-24-000001\nFILER:\nCOMPANY CONFORMED NAME:\tOld Name\n"
          "ITEM: a:b:c\nCOMPANY CONFORMED NAME:\tNew Name\nFILED AS OF DATE:\t20240131\n"
          "CONFORMED SUBMISSION TYPE:\t10-K\n</SEC-HEADER>\n")
SUBS = [
    (1, "a.txt", HEADER + block("EX-21.1", "<p>" + BODY + "</p>") + block("10-K", "<div>" + BODY + "</div>")
     + block("GRAPHIC", "binary" * 100) + block("EX-99.1") + block("ex-31.1", BODY, lower=True)
     + block("EX-99.2", "short")),
    (2, "b.txt", "no blocks at all " * 4000),
    (3, "c.txt", block("  ", BODY) + "<DOCUMENT>\n<TEXT>" + BODY + "</TEXT>\n</DOCUMENT>"),
]


def subs_df(spark):
    return spark.createDataFrame(SUBS, "submission_id long, file_name string, content string")


def test_split_sections_counts(spark):
    secs = S.split_sections(subs_df(spark))
    counts = {r.submission_id: r["count"] for r in secs.groupBy("submission_id").count().collect()}
    assert counts == {1: 6, 3: 2}
    types = [r.doc_type for r in secs.where("submission_id = 3").orderBy("section_pos").collect()]
    assert types == ["", "Unknown"]  # a blank TYPE strips to '', a missing one is 'Unknown'


def test_assembled_reports(spark):
    out = {r.submission_id: r for r in S.assemble_reports(subs_df(spark)).collect()}
    text = BODY.strip()
    # listed main types keep their file order; others follow; excluded types and blocks without text are out
    assert out[1].report == (f"=== EX-21.1 ===\n{text}\n\n\n=== 10-K ===\n{text}\n\n\n=== ex-31.1 ===\n{text}\n\n\n"
                             "=== EX-99.2 ===\nshort\n")
    assert out[2].used_fallback and out[2].report == SUBS[1][2]          # the whole content, however long
    assert out[3].report == f"===  ===\n{text}\n\n\n=== Unknown ===\n{text}\n"


def test_truncated_flag(spark):
    vals = ["Exhibit index and SIGNATURES", "exhibition hall", "Item 1. Business\nExhibit 21",
            "Item 15 " + "x" * 100000, "nothing"]
    df = spark.createDataFrame([(v,) for v in vals], "r string")
    got = [r.t for r in df.select(S.truncated_flag(F.col("r")).alias("t")).collect()]
    assert got == [True, True, False, True, False]           # by the markers, whatever the length


def test_header_map_last_wins(spark):
    rows = D.header_rows(subs_df(spark)).where("submission_id = 1").collect()
    m = {r.key: r.value for r in rows}
    assert m["COMPANY CONFORMED NAME"] == "New Name" and m["ITEM"] == "a:b:c" and m["FILER"] == ""
    meta = D.regex_metadata(F.col("content"))
    first = subs_df(spark).where("submission_id = 1").select(meta["company"].alias("c")).first().c
    assert first == "Old Name"  # the regex path takes the first hit, the map the last


def test_routing(spark):
    vals = ['<p ix:nonNumeric="x">', "xmlns:ix=", "<SEC-HEADER>", "ACCESSION NUMBER: 1", "<sec-header>",
            "ix:contextRef and <SEC-DOCUMENT>", "plain"]
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    got = [r.f for r in df.select(D.doc_format(F.col("c")).alias("f")).collect()]
    assert got == ["ixbrl", "ixbrl", "sgml", "sgml", "text", "ixbrl", "text"]


def test_sgml_body(spark):
    vals = ["<SEC-HEADER>h</SEC-HEADER>\n<DOCUMENT>\n<TYPE>10-K\nBody <b>bold</b>\n***\n</DOCUMENT>",
            "<SEC-HEADER>h</SEC-HEADER>after header", "just text"]
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    got = [r.b for r in df.select(D.sgml_body(F.col("c")).alias("b")).collect()]
    assert got == ["10-K\nBody bold", "after header", "just text"]


def test_main_slice(spark):
    vals = [
        block("EX-21", "Part I here Exhibit 21") + block("10-K", "Table Part I, Part IV\nPART I\nItem 1. Business text"
                                                         " more\nPart III gov\nPart IV exhibits"),
        "Intro Item 1. Overview stuff Part IV end",
        "no anchors at all",
        "Part I " + "x" * 12000 + " Item 1. Business y Part III z",
        "Part IV first then Part I later",
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, c string")
    got = [r.s for r in df.orderBy("i").select(J.main_slice(F.col("c")).alias("s")).collect()]
    assert got == ["", "Item 1. Overview stuff ", "no anchors at all", "Item 1. Business y ", ""]


def test_extract_html_status(spark):
    html = "<html><body><p>Main</p><ix:hidden>x</ix:hidden></body></html>"
    rows = [(1, "a.txt", block("10-K", html)), (2, "b.txt", block("EX-1", "no page")),
            (3, "c.txt", block("EX-1", html)), (4, "d.pdf", block("10-K", html))]
    df = spark.createDataFrame(rows, "submission_id long, file_name string, content string")
    out = {r.submission_id: r for r in J.extract_html(df, "2024-01-01 00:00:00").collect()}
    assert [out[i].status for i in range(1, 5)] == ["extracted", "no_html", "extracted", "skipped"]
    assert "<p>Main</p>" in out[1].html and "<ix:" not in out[1].html and out[2].html is None
    counts = {r.status: r.n_files for r in J.outcome_counts(J.extract_html(df, "t")).collect()}
    assert counts == {"extracted": 2, "no_html": 1, "skipped": 1}


def test_render_routes(spark):
    df = subs_df(spark).unionByName(spark.createDataFrame(
        [(4, "x.pdf", "text"), (5, "y.html", "plain <b>text</b>")], "submission_id long, file_name string, content string"))
    out = {r.submission_id: r for r in J.convert_to_html(df, "2024-01-01 00:00:00").collect()}
    assert out[1].doc_format == "sgml" and "New Name" in out[1].html and "2024-01-31" in out[1].html
    assert out[4].status == "skipped" and out[4].html is None
    assert out[5].doc_format == "text" and "plain <b>text</b>" in out[5].html


def test_api_render_documents_matches_routed_job(spark):
    from quillspark import api
    df = subs_df(spark)
    routed = {r.submission_id: r.html for r in J.convert_to_html(df, "t").collect()}
    sgml = {r.submission_id: r.html for r in api.render_documents(df, "sgml", "t").collect()}
    assert sgml[1] == routed[1]  # submission 1 routes to sgml
    text = api.render_documents(df, "text", "t").where("submission_id = 2").first().html
    assert text == routed[2]


def test_extract_glob_is_case_sensitive(spark):
    df = spark.createDataFrame([(1, "A.TXT", block("10-K", "<html></html>")), (2, "a.txt", "x")],
                               "submission_id long, file_name string, content string")
    out = {r.submission_id: r.status for r in J.extract_html(df, "t").collect()}
    assert out == {1: "skipped", 2: "no_html"}


def test_safe_mode_h9(spark):
    from quillspark.functions import text as T
    txt = "function go(a) { return a } kept prose. var x = 1\nmore prose; end"
    df = spark.createDataFrame([(txt,)], "t string")
    exact = df.select(T.clean_section_text(F.col("t")).alias("r")).first().r
    safe = df.select(T.clean_section_text(F.col("t"), compat=False).alias("r")).first().r
    assert exact == "kept prose. end"
    assert "kept prose." in safe and "more prose" in safe and "return a" not in safe
    sub = (7, "x.txt", block("EX-31.1", BODY) + block("10-K", BODY))
    d = spark.createDataFrame([sub], "submission_id long, file_name string, content string")
    r_exact = S.assemble_reports(d).first().report
    r_safe = S.assemble_reports(d, compat=False).first().report
    assert r_exact.startswith("=== EX-31.1 ===") and r_safe.startswith("=== 10-K ===")


def test_large_submission_runs_every_job(spark):
    # ~1.5 MB, with runs of unclosed tags: no regex stack overflow, no recursion limit
    para = '<p style="x">Item 1. Business word ' * 20 + "</p>\n<div class=\"c\">More text. </div>\n"
    body = "<html><body>" + para * 1200 + "</body></html>"
    content = HEADER + block("10-K", body) + block("EX-21.1", body[:200000])
    df = spark.createDataFrame([(9, "big.txt", content)], "submission_id long, file_name string, content string")
    rep = S.assemble_reports(df).first()
    assert rep.report.startswith("=== 10-K ===") and not rep.used_fallback
    page = J.convert_to_html(df, "t").first()
    assert page.doc_format == "sgml" and len(page.html) > 1000
    out = J.extract_html(df, "t").first()
    assert out.status == "extracted" and "Item 1. Business" in out.html


def test_report_keeps_everything_past_the_old_limits(spark):
    long = "word " * 30_000
    rows = [(1, "a.txt", "x" * 120_000), (2, "b.txt", block("10-K", "short one") + block("EX-99.1", long + "Exhibit 21"))]
    out = {r.submission_id: r for r in S.assemble_reports(spark.createDataFrame(
        rows, "submission_id long, file_name string, content string")).collect()}
    assert out[1].report == "x" * 120_000 and out[1].used_fallback
    assert out[2].report.startswith("=== 10-K ===\nshort one") and len(out[2].report) > 150_000 and out[2].truncated


def test_header_map_of_many_lines(spark):
    lines = "".join(f"KEY {i % 900}: value {i}\n" for i in range(4000))
    df = spark.createDataFrame([(1, f"<SEC-HEADER>\n{lines}</SEC-HEADER>")], "submission_id long, content string")
    got = [(r.key, r.value) for r in D.header_rows(df).collect()]
    assert got == [(f"KEY {i % 900}", f"value {i}") for i in range(3100, 4000)]


def test_nested_facts(spark):
    from quillspark.operators.facts import ix_facts
    content = ('<ix:nonNumeric name="a" contextRef="c1">before <ix:nonFraction name="b" contextRef="c2" unitRef="usd">5'
               '</ix:nonFraction> after <ix:nonNumeric name="d" contextRef="c">in<b>ner</b></ix:nonNumeric> end</ix:nonNumeric>'
               '<ix:numeric name="e" contextRef="c3"></ix:numeric><ix:nonFraction name="f" contextRef="c4"/>'
               '</ix:nonFraction><ix:nonNumeric name="open" contextRef="c5">never closed')
    df = spark.createDataFrame([(1, content), (2, "none"), (3, None)], "submission_id long, content string")
    got = [(r.fact_pos, r.tag, r.name, r.unit, r.value) for r in ix_facts(df).orderBy("fact_pos").collect()]
    assert got == [(0, "nonnumeric", "a", "", "before 5 after inner end"), (1, "nonfraction", "b", "usd", "5"),
                   (2, "nonnumeric", "d", "", "inner"), (3, "numeric", "e", "", "N/A"), (4, "nonfraction", "f", "", "N/A")]
