"""Sinks (K1-K5): output paths are columns; tables go through DataFrame writers, files of a row each through :mod:`.files`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.documents import html_to_text
from ..operators.pruning import LOG2_BITS, prune_to_keys
from .files import write_files


def with_suffix(path: Column, new_suffix: str) -> Column:
    """``Path.with_suffix``: replace the last suffix of the file name, or append one."""
    return F.when(path.rlike(r"\.[^./]*$"), F.regexp_replace(path, r"\.[^./]*$", new_suffix)) \
        .otherwise(F.concat(path, F.lit(new_suffix)))


def html_path(path: Column, layout: str = "sibling", input_root: str | None = None,
              output_dir: str | None = None) -> Column:
    """K2: where a rendered page goes.

    * ``sibling``     -- ``input.with_suffix('.html')``
    * ``html_subdir`` -- ``<parent>/html/<stem>.html`` (batch conversion)
    * ``mirror``      -- ``<output_dir>/<path relative to input_root>`` with ``.html``
    """
    if layout == "sibling":
        return with_suffix(path, ".html")
    if layout == "html_subdir":
        parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
        stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
        return F.concat(parent, F.lit("/html/"), stem, F.lit(".html"))
    if layout == "mirror":
        if input_root is None:
            raise ValueError("mirror layout needs input_root")
        root = input_root.rstrip("/") + "/"
        out = (output_dir or (input_root.rstrip("/").rsplit("/", 1)[0] + "/html")).rstrip("/") + "/"
        rel = F.when(path.startswith(root), path.substr(len(root) + 1, 1 << 30)).otherwise(path)
        return F.concat(F.lit(out), with_suffix(rel, ".html"))
    raise ValueError(f"unknown layout {layout}")


def pdf_paths(files: DataFrame, output_dir: str, path: str = "path", log2_bits: int = LOG2_BITS) -> DataFrame:
    """K5: every output flattened into ``output_dir/<stem>.pdf``; ``collides`` marks equal stems
    (the reference silently overwrites them).  All columns of ``files`` stay.

    Stems are counted in partial sums, so one that a third of the files share costs a row per task.  Files whose stem is not
    in a bitmap of the colliding ones stay where they are; only the others meet the colliding stems in a join.
    """
    stem = F.regexp_extract(F.col(path), r"([^/]*?)(\.[^./]*)?$", 1)
    out = files.withColumn("pdf_path", F.concat(F.lit(output_dir.rstrip("/") + "/"), stem, F.lit(".pdf")))
    twice = out.groupBy("pdf_path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("pdf_path", F.lit(True).alias("same"))
    free = prune_to_keys(out, twice, ["pdf_path"], log2_bits, others=True).withColumn("collides", F.lit(False))
    held = prune_to_keys(out, twice, ["pdf_path"], log2_bits).join(twice, "pdf_path", "left").withColumn(
        "collides", F.col("same").isNotNull())
    columns = [*files.columns, "pdf_path", "collides"]
    return free.select(columns).unionByName(held.select(columns))


def report_names(reports: DataFrame) -> DataFrame:
    """K1 naming: ``<ticker>/<ticker>_<filingDate>_10K.txt`` with an explicit collision flag
    (same ticker and date: the later filing in list order is the one kept)."""
    keys = reports.select("ticker", "file_name", "rank")
    last = keys.groupBy("ticker", "file_name").agg(F.max("rank").alias("kept_rank"), F.count(F.lit(1)).alias("n"))
    return (reports.join(last, ["ticker", "file_name"])  # keys and flags; the text moves in this join alone
            .withColumn("relative_path", F.concat_ws("/", "ticker", "file_name"))
            .withColumn("overwritten", F.col("rank") != F.col("kept_rank"))
            .drop("kept_rank", "n"))


def write_corpus(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: report table partitioned by ticker (partition pruning on read).

    Rows are dealt by ticker and balanced by their measured bytes when they have been shuffled (adaptive execution): a ticker
    above ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` is written by several tasks, a small one into one file.  Shuffle
    partitions are what is split, so there should be more of them than output bytes / advisory size.
    """
    df.hint("rebalance", "ticker").write.mode(mode).partitionBy("ticker").parquet(path)


def write_report_files(named: DataFrame, root: str, text: str = "content") -> None:
    """K1: ``<root>/<ticker>/<ticker>_<filingDate>_10K.txt`` for the rows of :func:`report_names` that are not overwritten."""
    write_files(named.where(~F.col("overwritten")), root, "relative_path", text)


def write_page_files(pages: DataFrame, root: str, html_col: str = "html", path_col: str = "output_path") -> None:
    """K2: each rendered page at its target path (:func:`html_path`) below ``root``; rows without a page give none."""
    write_files(pages, root, path_col, html_col)


def write_sidecar_files(pages: DataFrame, root: str, html_col: str = "html", path_col: str = "output_path") -> None:
    """K3: the text of each page (:func:`text_sidecar`) beside it."""
    write_files(text_sidecar(pages, html_col, path_col), root, "text_path", "text")


def write_pages(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: rendered pages with their target paths."""
    df.write.mode(mode).parquet(path)


def text_sidecar(pages: DataFrame, html_col: str = "html", path_col: str = "output_path") -> DataFrame:
    """K3: plain text next to each HTML page (T12 on the page)."""
    return html_to_text(pages.select(with_suffix(F.col(path_col), ".txt").alias("text_path"),
                                     F.col(html_col).alias("html")), "html").select("text_path", "text")


def write_summary(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4: run summary (A6) as CSV with a header."""
    summary.write.mode(mode).option("header", "true").csv(path)
