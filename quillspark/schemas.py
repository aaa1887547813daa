"""Explicit schemas of the landed payloads (no inference)."""

from pyspark.sql import types as T

TICKER_ITEM = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("cik_str", T.LongType()),
    T.StructField("title", T.StringType()),
])
TICKER_PAYLOAD = T.MapType(T.StringType(), TICKER_ITEM)

RECENT_FILINGS = T.StructType([
    T.StructField(n, T.ArrayType(T.StringType()))
    for n in ["form", "filingDate", "reportDate", "accessionNumber", "primaryDocument", "fileNumber"]
])
SUBMISSIONS_PAYLOAD = T.StructType([
    T.StructField("filings", T.StructType([T.StructField("recent", RECENT_FILINGS)])),
])

CONCEPT_RECORD = T.StructType([
    T.StructField("end", T.StringType()),
    T.StructField("val", T.DoubleType()),
    T.StructField("accn", T.StringType()),
    T.StructField("fy", T.LongType()),
    T.StructField("fp", T.StringType()),
    T.StructField("form", T.StringType()),
    T.StructField("filed", T.StringType()),
    T.StructField("frame", T.StringType()),
])
CONCEPT_PAYLOAD = T.StructType([
    T.StructField("cik", T.LongType()),
    T.StructField("taxonomy", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("units", T.MapType(T.StringType(), T.ArrayType(CONCEPT_RECORD))),
])

SUBMISSION_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])
