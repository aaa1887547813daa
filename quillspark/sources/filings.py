"""Filing-list scan (submissions JSON with parallel arrays)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import zero_fill

_FIELDS = ["form", "filingDate", "accessionNumber", "primaryDocument", "fileNumber"]


def filings_from_json(df: DataFrame, cik: str = "cik", value: str = "value") -> DataFrame:
    """One payload per company -> one row per listed filing, ``pos`` = array position.

    Rows are driven off ``form``; shorter arrays are padded with ''.  ``reportDate``
    repeats ``filingDate`` and ``size`` is 0, as in the reference.  A payload without
    ``filings.recent`` (or with it empty) yields no rows.
    """
    p = F.from_json(F.col(value), schemas.SUBMISSIONS_PAYLOAD)
    r = p["filings"]["recent"]
    # a missing array would make arrays_zip NULL: default each to empty (padded with '' below)
    empty = F.array().cast("array<string>")
    zipped = F.arrays_zip(*[F.coalesce(r[f], empty).alias(f) for f in _FIELDS])
    rows = df.select(zero_fill(F.col(cik)).alias("cik"), F.size(r["form"]).alias("n_forms"),
                     F.posexplode(zipped).alias("pos", "f"))
    rows = rows.where(F.col("pos") < F.col("n_forms"))
    filing_date = F.coalesce(F.col("f.filingDate"), F.lit(""))
    return rows.select(
        "cik", F.col("pos").cast("long").alias("pos"), F.col("f.form").alias("form"),
        filing_date.alias("filingDate"), filing_date.alias("reportDate"),
        F.coalesce(F.col("f.accessionNumber"), F.lit("")).alias("accession"),
        F.coalesce(F.col("f.primaryDocument"), F.lit("")).alias("primaryDocument"),
        F.coalesce(F.col("f.fileNumber"), F.lit("")).alias("fileNumber"),
        F.lit(0).cast("long").alias("size"))


def read_filings(spark, path: str) -> DataFrame:
    """Landed ``CIK##########.json`` files -> filing rows (cik from the file name)."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    raw = raw.withColumn("cik", F.regexp_extract("path", r"CIK(\d+)\.json$", 1))
    return filings_from_json(raw, "cik", "value")
