"""Composite jobs (C1-C7) and the per-file outcome table.

Each job is one lazily planned DataFrame; callers write it with a sink.
Costly text values are referenced once per expression (``let`` bindings,
``regexp_substr`` for "NULL on no match"), so neither projection collapsing nor
predicate push-down can repeat a regex chain for one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import companies as C
from ..operators import documents as D
from ..operators import filings as FL
from ..operators import outline as O
from ..operators import render as R
from ..operators import sections as S
from . import bridge as B

# First <DOCUMENT> whose TYPE starts with 10-K (dotall: may run into the next
# block when that one has no <TEXT>); fallback: first <TEXT> holding a whole <html> page.
MAIN_10K = P.Rx(rf"<DOCUMENT>{P.S}*<TYPE>10-K.*?<TEXT>(.*?)</TEXT>", "si")
ANY_HTML_TEXT = P.Rx(r"<TEXT>(.*?<html.*?</html>.*?)</TEXT>", "si")
CONVERTIBLE_SUFFIXES = [".txt", ".html"]


def suffix(path: Column) -> Column:
    """Lower-cased file suffix including the dot ('' when none)."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


# ---------------------------------------------------------------------------
# Flagship: assembled reports with metadata
# ---------------------------------------------------------------------------
def assembled_reports(subs: DataFrame) -> DataFrame:
    """Submissions -> format, metadata, assembled report, fallback and truncated flags."""
    base = subs.select("submission_id", "file_name", "content",
                       D.doc_format(F.col("content")).alias("doc_format"))
    base = D.with_regex_metadata(base, "content", "file_name")
    keep = ("submission_id", "file_name", "doc_format", *D.METADATA_FIELDS)
    rep = S.assemble_reports(base, keep=keep)
    return rep.withColumn("n_chars", F.length("report").cast("long"))


def report_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembled_reports(B.view(spark, sf_dir, "submissions"))


# ---------------------------------------------------------------------------
# Convert to HTML with routing
# ---------------------------------------------------------------------------
def convert_to_html(subs: DataFrame, generated_at: str, name_col: str = "file_name") -> DataFrame:
    """P12 suffix filter, P10 routing, then the page of the chosen format.

    Only the branch of the row's format is evaluated (CASE is lazy per row), and
    each branch binds its costly values once (``let``), so a filter pushed onto
    ``html`` copies the page expression once rather than multiplying it.
    """
    fname = F.col(name_col)
    df = subs.select("submission_id", name_col, "content",
                     F.when(suffix(fname).isin(CONVERTIBLE_SUFFIXES), D.doc_format(F.col("content")))
                     .alias("doc_format"))
    ix_page = T.let(S.report_struct(F.col("content")), lambda rs: R.filing_page(
        D.regex_metadata(F.col("content"), fname),
        T.mark_titles(T.clean_ixbrl_text(rs["report"])), generated_at, notice=rs["truncated"]))
    sgml_page = T.let(D.header_map(F.col("content")), lambda h: R.filing_page(
        D.sgml_metadata(h), D.sgml_body(F.col("content")), generated_at))
    text_page = R.text_page(fname, F.col("content"), generated_at)
    fmt = F.col("doc_format")
    html = (F.when(fmt == "ixbrl", ix_page).when(fmt == "sgml", sgml_page)
            .when(fmt == "text", text_page))
    out = df.select("submission_id", name_col, "doc_format", html.alias("html"))
    return out.withColumn("status", F.when(F.col("doc_format").isNull(), "skipped").otherwise("converted"))


# ---------------------------------------------------------------------------
# Pure-HTML extraction (W3 -> T15 -> T19d)
# ---------------------------------------------------------------------------
def main_html(content: Column) -> Column:
    """W3 on the raw content: the 10-K body, else a body holding a whole page; NULL when none.

    ``coalesce`` only runs the fallback search when the first one misses.
    """
    return F.coalesce(T.field_or_null(content, MAIN_10K), T.field_or_null(content, ANY_HTML_TEXT))


def extract_html(subs: DataFrame, generated_at: str, name_col: str = "file_name") -> DataFrame:
    """``status`` is ``extracted`` or ``no_html``; ``skipped`` for non-.txt files."""
    fname = F.col(name_col)
    meta = D.regex_metadata(F.col("content"))
    eligible = fname.endswith(".txt")  # a case-sensitive "*.txt" glob, as the directory scan uses
    base = subs.select("submission_id", name_col, eligible.alias("eligible"),
                       *[v.alias(k) for k, v in meta.items()],
                       F.when(eligible, main_html(F.col("content"))).alias("body"))
    base = base.withColumn("clean_body", T.clean_html_regex(F.col("body")))
    page = R.filing_page({k: F.col(k) for k in D.METADATA_FIELDS}, F.col("clean_body"), generated_at, source=fname)
    status = (F.when(~F.col("eligible"), "skipped").when(F.col("body").isNull(), "no_html")
              .otherwise("extracted"))
    return base.select("submission_id", name_col, status.alias("status"),
                       F.when(F.col("body").isNotNull(), page).alias("html"))


def outcome_counts(results: DataFrame) -> DataFrame:
    """Files per status, plus the exit status rule (ok iff at least one success)."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"))


def exit_ok(results: DataFrame, success: Sequence[str] = ("extracted", "converted")) -> DataFrame:
    return results.agg(F.count_if(F.col("status").isin(list(success))).alias("n_ok")) \
        .select((F.col("n_ok") > 0).alias("ok"))


# ---------------------------------------------------------------------------
# Main-report slice (Java-only: lookahead)
# ---------------------------------------------------------------------------
_ITEM1_BUSINESS = r"(?isU)Item 1\.\s*Business"
_PART1 = r"(?isU)\bPart I\b(?!\s*[,V])"
_EX_TYPE = r"(?isU)<TYPE>EX-"
_EXHIBIT_N = r"(?isU)Exhibit\s+\d+"
_ITEM1 = r"(?isU)\bItem 1\."
_PART4 = r"(?isU)\bPart IV\b"
_PART3 = r"(?isU)\bPart III\b"


def _slice(s: Column, start: Column, end: Column) -> Column:
    """Python ``s[start-1:end-1]`` for 1-based positions, ``end`` 0 meaning to the end."""
    return F.when(end > 0, s.substr(start, end - start)).otherwise(s.substr(start, F.length(s)))


def main_slice(content: Column) -> Column:
    """T17.  Every searched position is computed once and bound (``let``), so the
    section pick and the slices are not repeated inside the expression."""
    blocks = F.regexp_extract_all(content, F.lit(P.DOCUMENT_BLOCK.java), 0)
    main = F.try_element_at(F.filter(blocks, lambda b: (b.rlike(_ITEM1_BUSINESS) | b.rlike(_PART1))
                                     & ~b.rlike(_EX_TYPE) & ~b.rlike(_EXHIBIT_N)), F.lit(1))

    def narrow(fp):
        return T.let(F.struct(F.regexp_instr(fp, F.lit(_ITEM1_BUSINESS)).alias("bm"),
                              F.regexp_instr(fp, F.lit(_PART3)).alias("p3")),
                     lambda r: F.when(r["bm"] > 0, _slice(fp, r["bm"], r["p3"]))
                     .otherwise(fp))

    def on_section(s):
        marks = F.struct(F.regexp_instr(s, F.lit(_PART1)).alias("p1"), F.regexp_instr(s, F.lit(_ITEM1)).alias("i1"),
                         F.regexp_instr(s, F.lit(_PART4)).alias("p4"))
        return T.let(marks, lambda q: F.when(q["p1"] > 0, T.let(_slice(s, q["p1"], q["p4"]), narrow))
                     .when(q["i1"] > 0, _slice(s, q["i1"], q["p4"])).otherwise(s))

    return T.let(F.coalesce(main, content), on_section)


def main_slices(subs: DataFrame) -> DataFrame:
    """T17 per submission (staged: the slice is built once, then measured)."""
    df = subs.select("submission_id", main_slice(F.col("content")).alias("main_text"))
    return df.withColumn("n_chars", F.length("main_text"))


# ---------------------------------------------------------------------------
# C1, C4, C5, C6, C7
# ---------------------------------------------------------------------------
def corpus_build(requested: DataFrame, companies: DataFrame, filings: DataFrame, landed: DataFrame,
                 docs: DataFrame, max_reports: int = 5) -> DataFrame:
    """Tickers -> latest annual reports -> landed text or fallback document, with file names.

    ``filings`` as S2 makes them, ``landed`` as S3 (``cik, accession, content``).
    """
    known = C.resolve_tickers(requested, companies)
    chosen = FL.company_filings(known.select("ticker", "cik", "req_pos"), filings.select(
        "cik", "form", "pos", "filingDate", "accession"), "10-K", max_reports)
    return FL.attach_text(chosen.select("ticker", "cik", "accession", "filingDate", "rank", "req_pos"), landed, docs)


def pdf_paragraphs(rendered: DataFrame, key: str = "submission_id") -> DataFrame:
    """C4 data half: rendered page -> T12 text -> W5 paragraphs (page drawing is not built)."""
    # filter on the cheap status column: a filter on the page column itself would be
    # pushed below the projection and evaluate the page expression twice
    return O.paragraphs(D.html_to_text(rendered.where(F.col("status") == "converted"), "html"), key, "text")


def selection_summary(companies: DataFrame, terms: Sequence[str], filings: DataFrame, landed: DataFrame,
                      docs: DataFrame, max_reports: int = 3) -> DataFrame:
    """Companies picked by terms -> latest annual reports (C1) -> run summary."""
    picked = C.select_companies(companies, terms).select(F.col("term_pos").alias("req_pos"), "ticker")
    reports = corpus_build(picked, companies, filings, landed, docs, max_reports)
    return FL.run_summary(C.resolve_tickers(picked, companies), reports)
