"""Concept series (S5, O3, C7) and inline-XBRL facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T

# Open and close tags of facts; nested facts pair by name and depth.
_KINDS = ("nonfraction", "nonnumeric", "numeric")
IX_TAG = r"(?is)<ix:(?:nonfraction|nonnumeric|numeric)\b[^>]*>|</ix:(?:nonfraction|nonnumeric|numeric)\s*>"
NO_VALUE = "N/A"


def read_concepts(df: DataFrame, value: str = "value") -> DataFrame:
    """Company-concept payloads -> one row per (unit, record)."""
    p = F.from_json(F.col(value), schemas.CONCEPT_PAYLOAD)
    units = df.select(p.alias("p")).select("p.cik", "p.taxonomy", F.col("p.tag").alias("concept"),
                                           F.explode("p.units").alias("unit", "recs"))
    return units.select("cik", "taxonomy", "concept", "unit", F.inline("recs"))


def concept_series(facts: DataFrame, concept: str | None = None, unit: str | None = None) -> DataFrame:
    """Values over time, sorted by period end; ties by filing date, then accession (columns of S5).

    A global ``orderBy`` is range-partitioned, so one concept holding most of
    the rows is still spread over many tasks.
    """
    df = facts
    if concept is not None:
        df = df.where(F.col("concept") == concept)
    if unit is not None and "unit" in df.columns:
        df = df.where(F.col("unit") == unit)
    return (df.select("concept", "end", "val", F.to_date("filed").alias("filed_date"), "accn", "filed")
            .orderBy("concept", "end", "filed", "accn").drop("filed"))


def _paired(tags: Column, kind: str) -> Column:
    """array<struct<open, close>>: places of the tags of one kind that belong together."""
    own = F.filter(F.transform(tags, lambda t, k: F.struct(
        k.alias("k"), F.startswith(t, F.lit("</")).alias("closing"), t.alias("t"))), lambda x: (
        F.lower(F.regexp_extract(x["t"], r"^</?ix:([A-Za-z]+)", 1)) == kind) & ~F.endswith(x["t"], F.lit("/>")))
    return F.filter(T.paired(own), lambda p: p["close"].isNotNull())


def fact_array(content: Column) -> Column:
    """array<struct<tag, name, context, unit, value>> in the order of the open tags.

    A value is all text up to the fact's own close tag, nested facts included and other markup left out; an empty one is
    ``N/A``.  Tags without a partner make no fact; ``<ix:... />`` is an empty one.
    """
    pieces = F.split(content, IX_TAG, -1)
    tags = F.regexp_extract_all(content, F.lit(IX_TAG), 0)

    def attribute(tag, name):
        return F.regexp_extract(tag, rf'(?is)\b{name}\s*=\s*"([^"]*)"', 1)

    def fact(tag, value):
        return F.struct(
            F.lower(F.regexp_extract(tag, r"(?i)^<ix:([a-z]+)", 1)).alias("tag"), attribute(tag, "name").alias("name"),
            attribute(tag, "contextref").alias("context"), attribute(tag, "unitref").alias("unit"),
            F.when(value == "", NO_VALUE).otherwise(value).alias("value"))

    def build(b):
        closed = F.filter(F.transform(b["tags"], lambda t, k: F.when(
            F.endswith(t, F.lit("/>")), F.struct(k.alias("open"), k.alias("close")))), lambda p: p.isNotNull())
        pairs = F.array_sort(F.concat(closed, *[_paired(b["tags"], kind) for kind in _KINDS]))
        return F.transform(pairs, lambda p: T.let(F.regexp_replace(F.array_join(F.slice(
            b["pieces"], p["open"] + 2, p["close"] - p["open"]), ""), "<[^>]+>", ""),
            lambda v: fact(F.get(b["tags"], p["open"]), v)))
    return T.let(F.struct(tags.alias("tags"), pieces.alias("pieces")), build)


def ix_facts(subs: DataFrame, key: str = "submission_id", col: str = "content") -> DataFrame:
    """T20 as rows: (key, fact_pos, tag, name, context, unit, value)."""
    return subs.select(key, F.posexplode(fact_array(F.col(col))).alias("fact_pos", "f")).select(key, "fact_pos", "f.*")
