"""Company master scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas

ITEM_SCHEMA = "struct<ticker:string, cik_str:long, title:string, cik:long>"


def company_items_from_json(df: DataFrame, value: str = "value", pos: str = "src_pos",
                            accept_cik_key: bool = False) -> DataFrame:
    """One JSON item per row (``value``) -> ``ticker, cik_str, title, src_pos``.

    Non-object items parse to NULL and fall out with P11 (both keys present).
    ``accept_cik_key`` also takes the id from a ``cik`` key when ``cik_str`` is
    missing (off by default: the reference code requires ``cik_str``).
    """
    v = F.col(value)
    item = F.when(F.ltrim(v).startswith("{"), F.from_json(v, ITEM_SCHEMA))
    cik = F.coalesce(F.col("i.cik_str"), F.col("i.cik")) if accept_cik_key else F.col("i.cik_str")
    return (df.select(F.col(pos).alias("src_pos"), item.alias("i"))
            .where(F.col("i").isNotNull())
            .select("i.ticker", cik.alias("cik_str"), "i.title", "src_pos"))


def company_items_from_payload(df: DataFrame, value: str = "value", accept_cik_key: bool = False,
                               file: str | None = None) -> DataFrame:
    """The whole master file as one JSON object of objects (``{"0": {...}, "1": {...}}``).

    Items keep the file order as ``src_pos`` (key order of the object); with a ``file`` column it is (file, position), which
    orders the items of several files.  A non-object item becomes NULL under the explicit schema and is dropped.
    """
    # values stay raw JSON text, so one non-object item drops alone, not the whole payload
    m = F.from_json(F.col(value), "map<string,string>")
    items = df.select(*([F.col(file).alias("file")] if file else []),
                      F.posexplode(F.map_values(m)).alias("src_pos", "value"))
    at = F.col("src_pos").cast("long")
    at = F.struct("file", at.alias("pos")) if file else at
    return company_items_from_json(items.withColumn("src_pos", at), accept_cik_key=accept_cik_key)


def read_companies(spark, path: str) -> DataFrame:
    """Read landed master files (one JSON object per file) and return item rows.

    ``src_pos`` is (file path, position): files count in path order, so A1's last record is that of the last file.
    """
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return company_items_from_payload(raw, file="file")
