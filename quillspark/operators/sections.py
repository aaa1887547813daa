"""Sections and report assembly.

A submission's sections come from, and go back into, the same row: the split,
the per-section clean and the ordered re-assembly are higher-order functions
over the array of <DOCUMENT> blocks.  No section text is shuffled, and one
multi-MB submission costs one task, never a group gathered from many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

_TEXT_OPEN = len("<TEXT>")
_TEXT_TAGS = len("<TEXT></TEXT>")


def _section_type(block: Column) -> Column:
    """First ``<TYPE>`` value stripped; 'Unknown' only when there is none."""
    return F.coalesce(T.field_or_null(block, P.TYPE_VALUE, stripped=True), F.lit(P.UNKNOWN))


def section_array(content: Column) -> Column:
    """array<struct<section_pos, doc_type, has_text, raw_text>>.

    Two passes over the block array so that each block's <TEXT> match is
    extracted once (a lambda has no common-subexpression elimination).
    """
    blocks = F.regexp_extract_all(content, F.lit(P.DOCUMENT_BLOCK.java), 0)
    matched = F.transform(blocks, lambda b, i: F.struct(
        i.alias("section_pos"), _section_type(b).alias("doc_type"),
        F.regexp_extract(b, P.TEXT_BODY.java, 0).alias("whole")))  # tags are fixed-length under (?i)
    return F.transform(matched, lambda m: F.struct(
        m["section_pos"].alias("section_pos"), m["doc_type"].alias("doc_type"),
        (m["whole"] != "").alias("has_text"),
        m["whole"].substr(F.lit(_TEXT_OPEN + 1), F.length(m["whole"]) - _TEXT_TAGS).alias("raw_text")))


def excluded(doc_type: Column) -> Column:
    """P14 (exact, case-insensitive)."""
    return F.upper(doc_type).isin(P.EXCLUDED_TYPES)


def section_rank(doc_type: Column, compat: bool = True) -> Column:
    """0 for listed main types, 1 for the rest (file order kept inside each).

    ``compat=False`` ranks main types by their place in the list (10-K before 10-Q ...).
    """
    if compat:
        return F.when(F.upper(doc_type).isin(P.MAIN_TYPES), 0).otherwise(1)
    rank = None
    for i, t in enumerate(P.MAIN_TYPES):
        cond = F.upper(doc_type) == t
        rank = F.when(cond, i) if rank is None else rank.when(cond, i)
    return rank.otherwise(len(P.MAIN_TYPES))


def split_sections(subs: DataFrame) -> DataFrame:
    """T5-T7 as rows: one per <DOCUMENT> block (narrow: explode only)."""
    return subs.select("submission_id", F.inline(section_array(F.col("content"))))


def clean_sections(sections: DataFrame, compat: bool = True) -> DataFrame:
    """P14 before T11, then P13 and P15 on the section rows."""
    kept = sections.where(F.col("has_text") & ~excluded(F.col("doc_type")))
    cleaned = kept.withColumn("clean_text", T.clean_section_text(F.col("raw_text"), compat)).drop("raw_text")
    return (cleaned.withColumn("substantial", F.length("clean_text") > P.SUBSTANTIAL_CHARS)
            .withColumn("rank", section_rank(F.col("doc_type"), compat)))


def _kept_sections(content: Column, compat: bool = True) -> Column:
    """P14 -> T11 -> P15 inside the row; every non-empty section stays: array<struct<rank, section_pos, doc_type, clean>>."""
    secs = F.filter(section_array(content), lambda s: s["has_text"] & ~excluded(s["doc_type"]))
    cleaned = F.transform(secs, lambda s: F.struct(
        section_rank(s["doc_type"], compat).alias("rank"), s["section_pos"].alias("section_pos"),
        s["doc_type"].alias("doc_type"), T.clean_section_text(s["raw_text"], compat).alias("clean")))
    return F.filter(cleaned, lambda s: s["clean"] != "")


def report_text(kept: Column) -> Column:
    """A5: ``=== TYPE ===`` blocks, main sections first, each group in file order."""
    blocks = F.transform(F.array_sort(kept), lambda s: F.concat(
        F.lit("=== "), s["doc_type"], F.lit(" ===\n"), s["clean"], F.lit("\n")))
    return F.array_join(blocks, "\n\n")


def truncated_flag(report: Column) -> Column:
    """P16 on the assembled text (before the iXBRL clean), by its markers whatever its length."""
    return report.rlike(P.EXHIBIT_MARKERS.java) & ~report.rlike(P.MAIN_MARKERS.java)


def report_struct(content: Column, compat: bool = True) -> Column:
    """struct<report, used_fallback, truncated> for one submission (A5 + fallback + P16).

    The assembled text is bound once (``let``) and everything else derives from
    that binding, so no plan rewrite can repeat the section pipeline.
    """
    return T.let(report_text(_kept_sections(content, compat)), lambda r: T.let(
        F.when(r == "", content).otherwise(r),
        lambda rep: F.struct(rep.alias("report"), (r == "").alias("used_fallback"),
                             truncated_flag(rep).alias("truncated"))))


def assemble_reports(subs: DataFrame, keep: tuple[str, ...] = ("submission_id",), compat: bool = True) -> DataFrame:
    """A5 + P16 per submission; falls back to the whole content when nothing is kept.

    ``compat=False`` (H9) ranks main sections by list order and uses the safe T11 script patterns.
    """
    return (subs.select(*keep, report_struct(F.col("content"), compat).alias("r"))
            .select(*keep, "r.report", "r.used_fallback", "r.truncated"))


def section_stats(subs: DataFrame) -> DataFrame:
    """Per section type: found, skipped by type, kept (non-empty), substantial among them, characters kept."""
    secs = split_sections(subs).drop("submission_id")
    ex = excluded(F.col("doc_type"))
    clean = F.when(F.col("has_text") & ~ex, T.clean_section_text(F.col("raw_text")))
    s = secs.select("doc_type", ex.alias("excluded"), clean.alias("clean"))
    s = s.select("doc_type", "excluded", F.length("clean").alias("n"))
    return s.groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("n_sections"),
        F.count_if(F.col("excluded")).alias("n_skipped"),
        F.count_if(F.col("n") > 0).alias("n_kept"),
        F.count_if(F.col("n") > P.SUBSTANTIAL_CHARS).alias("n_substantial"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("chars_kept"))
