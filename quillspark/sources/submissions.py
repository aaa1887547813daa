"""S3: submission text files and S6: landed fetch results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import patterns as P
from ..functions import text as T
from ..operators.filings import content_extension


# One run of ASCII or one well-formed multi-byte sequence, over bytes read as Latin-1.
_UTF8 = (r"[\x00-\x7F]+|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}"
         r"|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}"
         r"|\xF4[\x80-\x8F][\x80-\xBF]{2}")


def decode_text(body: Column) -> Column:
    """UTF-8 decode that drops undecodable bytes and nothing else, then newline translation (``\\r\\n``, ``\\r`` -> ``\\n``).

    Valid files are cast; of others the well-formed sequences are kept, so a genuine U+FFFD stays.
    """
    kept = F.array_join(F.regexp_extract_all(F.decode(body, "ISO-8859-1"), F.lit(_UTF8), 0), "")
    text = F.when(F.is_valid_utf8(body), body.cast("string")) \
        .otherwise(F.encode(kept, "ISO-8859-1").cast("string"))
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def submission_keys(content: Column, file_name: Column) -> tuple[Column, Column]:
    """(cik, accession) of a landed submission: from its header, else the accession from its file name."""
    accession = F.coalesce(T.field_or_null(content, P.ACCESSION_FIELD), T.field_or_null(file_name, P.ACCESSION_IN_NAME))
    cik = F.regexp_extract(F.regexp_substr(content, F.lit(_CIK)), _CIK, 1)
    return T.zero_fill(F.coalesce(cik, F.regexp_extract(accession, r"^([0-9]+)-", 1))), accession


_CIK = r"CENTRAL INDEX KEY:\s*([0-9]+)"


def read_submissions(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Recursive ``*.txt`` discovery under ``path``; one row per file, keyed by its path.

    ``binaryFile`` splits by file, so each multi-MB submission is one row of one
    task; only the path and the decoded text leave the scan.  ``cik`` and ``accession`` join it to the filing list.
    """
    raw = (spark.read.format("binaryFile").schema(schemas.SUBMISSION_FILE)
           .option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path))
    return submission_rows(raw)


def submission_rows(raw: DataFrame) -> DataFrame:
    """Rows of ``binaryFile`` -> submissions (batch and stream)."""
    rows = raw.select(
        F.col("path").alias("submission_id"), "path",
        F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
        decode_text(F.col("content")).alias("content"), F.col("length").alias("n_bytes"))
    cik, accession = submission_keys(F.col("content"), F.col("file_name"))
    return rows.withColumns({"cik": cik, "accession": accession})


def typed_documents(fetched: DataFrame) -> DataFrame:
    """S6 + P9: ``(url, content_type, body)`` -> extension and decoded text."""
    return fetched.select(
        "url", "content_type",
        content_extension(F.col("content_type"), F.col("url")).alias("ext"),
        decode_text(F.col("body")).alias("text"),
        F.octet_length("body").cast("long").alias("n_bytes"))
