"""Submission-level operators: routing, header map, metadata, cleaning.

All are projections over a ``content`` column: no shuffle, text never leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

# --- fixed values that must equal the reference --------------------------------
# Company name forced when the file name contains the key (content still overrides).
NAME_OVERRIDES = {"JXN": "Jackson Financial Inc."}
# -------------------------------------------------------------------------------


# ---------------------------------------------------------------------------
# P10 routing
# ---------------------------------------------------------------------------
def _contains_any(c: Column, markers) -> Column:
    cond = F.lit(False)
    for m in markers:
        cond = cond | c.contains(m)
    return cond


def is_ixbrl(c: Column) -> Column:
    return _contains_any(c, P.IXBRL_MARKERS)


def is_sgml(c: Column) -> Column:
    return _contains_any(c, P.SGML_MARKERS)


def doc_format(c: Column) -> Column:
    """``ixbrl`` before ``sgml`` before ``text``."""
    return F.when(is_ixbrl(c), "ixbrl").when(is_sgml(c), "sgml").otherwise("text")


def route(subs: DataFrame, content: str = "content") -> DataFrame:
    return subs.withColumn("doc_format", doc_format(F.col(content)))


# ---------------------------------------------------------------------------
# T1 + A8 header map
# ---------------------------------------------------------------------------
def header_entries(content: Column) -> Column:
    """array<struct<key,value>> of ``KEY: value`` header lines, repeated keys -> last wins."""
    hdr = F.regexp_extract(content, P.HEADER_BLOCK.java, 1)
    lines = F.filter(F.split(hdr, "\n", -1), lambda l: l.contains(":"))
    entries = F.transform(lines, lambda l: F.struct(
        T.strip(F.substring_index(l, ":", 1)).alias("key"),
        T.strip(l.substr(F.instr(l, ":") + 1, F.length(l))).alias("value")))
    # sorted by key, the last line of a key first: an entry stays if the one before it has another key
    ranked = F.array_sort(F.transform(entries, lambda e, i: F.struct(
        e["key"].alias("key"), (-i).alias("back"), e["value"].alias("value"))))
    last = T.let(ranked, lambda es: F.filter(es, lambda e, i: (i == 0) | (
        F.element_at(es, F.greatest(i, F.lit(1)))["key"] != e["key"])))
    return F.transform(F.array_sort(F.transform(last, lambda e: F.struct(
        (-e["back"]).alias("line"), e["key"].alias("key"), e["value"].alias("value")))),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def header_map(content: Column) -> Column:
    return F.map_from_entries(header_entries(content))


def header_rows(subs: DataFrame) -> DataFrame:
    """A8 as rows: (submission_id, key, value)."""
    return (subs.select("submission_id", F.inline(header_entries(F.col("content")))))


def sgml_metadata(hmap: Column) -> dict[str, Column]:
    """T19b fields from the header map, with the map-path defaults."""
    def get(k, d):
        return F.coalesce(F.try_element_at(hmap, F.lit(k)), F.lit(d))
    filed = get("FILED AS OF DATE", P.UNKNOWN)
    return {
        "company": get("COMPANY CONFORMED NAME", P.UNKNOWN_COMPANY),
        "accession": get("ACCESSION NUMBER", P.UNKNOWN),
        "filing_date": F.when(filed != P.UNKNOWN, T.dash_date(filed)).otherwise(filed),
        "document_type": get("CONFORMED SUBMISSION TYPE", P.UNKNOWN),
    }


# ---------------------------------------------------------------------------
# T2-T4 metadata by regex (iXBRL and extract paths)
# ---------------------------------------------------------------------------
def regex_metadata(content: Column, file_name: Column | None = None,
                   name_overrides: dict[str, str] | None = None) -> dict[str, Column]:
    """First-hit header fields over the whole content; file-name fallbacks when given.

    ``file_name`` set = iXBRL path (T3 fallbacks + name overrides); unset = extract
    path.  Each field scans the content once and references it once.
    """
    company = F.lit(P.UNKNOWN_COMPANY)
    acc_name = F.lit(None).cast("string")
    date_name = F.lit(None).cast("string")
    if file_name is not None:
        overrides = NAME_OVERRIDES if name_overrides is None else name_overrides
        for key, name in overrides.items():
            company = F.when(file_name.contains(key), F.lit(name)).otherwise(company)
        acc_name = T.field_or_null(file_name, P.ACCESSION_IN_NAME)
        date_name = T.field_or_null(file_name, P.DATE_IN_NAME)
    return {
        "company": F.coalesce(T.field_or_null(content, P.COMPANY_FIELD, stripped=True), company),
        "accession": F.coalesce(T.field_or_null(content, P.ACCESSION_FIELD), acc_name, F.lit(P.UNKNOWN)),
        "filing_date": F.coalesce(T.dash_date(T.field_or_null(content, P.FILED_FIELD)), date_name,
                                  F.lit(P.UNKNOWN)),
        "document_type": F.coalesce(T.field_or_null(content, P.TYPE_FIELD, stripped=True),
                                    F.lit(P.DEFAULT_REGEX_DOC_TYPE)),
    }


METADATA_FIELDS = ["company", "accession", "filing_date", "document_type"]


def with_regex_metadata(df: DataFrame, content: str = "content", file_name: str | None = "file_name") -> DataFrame:
    m = regex_metadata(F.col(content), F.col(file_name) if file_name else None)
    return df.select("*", *[v.alias(k) for k, v in m.items()])


def metadata(subs: DataFrame, use_file_name: bool = True) -> DataFrame:
    """T2-T4 as columns on the submissions table."""
    m = regex_metadata(F.col("content"), F.col("file_name") if use_file_name else None)
    return subs.select("submission_id", *[v.alias(k) for k, v in m.items()])


# ---------------------------------------------------------------------------
# T8 + T9 SGML body
# ---------------------------------------------------------------------------
def sgml_body(content: Column) -> Column:
    """First case-sensitive <DOCUMENT> body, else text after </SEC-HEADER>, else all; then T9.

    Written with single references so the content scans run once each.
    """
    first = T.field_or_null(content, P.FIRST_DOCUMENT_BODY)
    after = F.substring(F.regexp_substr(content, F.lit(r"(?s)</SEC-HEADER>.*")), len("</SEC-HEADER>") + 1,
                        2147483647)
    return T.clean_sgml_text(F.coalesce(first, after, content))


def clean_sgml(subs: DataFrame) -> DataFrame:
    return subs.select("submission_id", sgml_body(F.col("content")).alias("clean_text"))


def clean_ixbrl(df: DataFrame, col: str = "content") -> DataFrame:
    return df.withColumn("clean_text", T.clean_ixbrl_text(F.col(col)))


def html_to_text(df: DataFrame, col: str = "html", mode: str = "parser") -> DataFrame:
    """T12 (``mode='parser'``) or its regex fallback T13 (``mode='strict'``), both as Column expressions.

    T12 decodes every named and numeric character reference of HTML 5.
    """
    if mode != "parser":
        return df.withColumn("text", T.html_to_text_strict(F.col(col)))
    return df.withColumn("text", T.html_to_text(F.col(col)))


def clean_html_regex(df: DataFrame, col: str = "html") -> DataFrame:
    """T15."""
    return df.withColumn("clean_html", T.clean_html_regex(F.col(col)))


def size_columns(c: Column) -> list[Column]:
    """P17 + P18: characters, bytes, MB and the renderer size gate."""
    b = F.octet_length(c)
    return [F.length(c).cast("long").alias("n_chars"), b.cast("long").alias("n_bytes"),
            (b / 1024.0 / 1024.0).alias("size_mb"),
            (b > P.RENDER_SIZE_GATE_BYTES).alias("too_large")]


def clean_html(df: DataFrame, col: str = "html", out: str = "clean_html") -> DataFrame:
    """T15 under a name of the caller's."""
    return df.withColumn(out, T.clean_html_regex(F.col(col)))
