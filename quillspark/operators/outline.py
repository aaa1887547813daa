"""Outline (T16b), chapter-title mark-up (T16) and paragraphs (W5), all per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def mark_titles(df: DataFrame, col: str = "text", out: str = "marked") -> DataFrame:
    """Wrap chapter-title lines in <strong>; lines are stripped, blanks kept."""
    return df.withColumn(out, T.mark_titles(F.col(col)))


def outline(df: DataFrame, key: str, col: str = "text") -> DataFrame:
    """One row per title line: ``(key, line_pos, title, kind, number)``."""
    lines = df.select(key, F.posexplode(T.stripped_lines(F.col(col))).alias("line_pos", "title"))
    titles = lines.where((F.col("title") != "") & T.is_chapter_title(F.col("title")))
    titles = titles.withColumn("kind", T.title_kind(F.col("title")))
    return titles.withColumn("number", T.title_number(F.col("title"), F.col("kind")))


def paragraphs(df: DataFrame, key: str, col: str = "text") -> DataFrame:
    """``(key, para_pos, kind, text)``; header lines are their own rows."""
    return (df.select(key, F.posexplode(T.paragraph_array(F.col(col))).alias("para_pos", "p"))
            .select(key, "para_pos", "p.kind", "p.text"))
