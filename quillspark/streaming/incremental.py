"""Incremental conversion of newly landed submission files (Structured Streaming).

``binaryFile`` stream -> ``foreachBatch`` running a batch job -> parquet, with
``trigger(availableNow=True)``: each run converts only files the checkpoint has
not seen, ``max_files`` at a time.  ``foreachBatch`` because the jobs contain ordered per-row assembly
and joins that append-mode streaming aggregation would not allow.

The output is a versioned table in hash buckets of the file's key, so the number of folders does not grow with the files::

    <out>/generation=<g>/rows/bucket=<k>/   rows of a batch, under the name of the attempt that wrote them
    <out>/generation=<g>/files/             file key, version and attempt: what a batch has converted

A batch appends its rows first and the list of its files last; the list is the commit.  Rows of an attempt that was cut off
are in no list and are never read.  A file's rows are those of the newest version that lists it, so a replayed batch, or a
run under a new checkpoint, replaces them, and a file that no longer yields any row loses its old ones.
:func:`compact` writes what is newest as the next generation and drops the older ones.  One writer at a time is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import checkpoint_root
from ..sources.submissions import submission_rows

BUCKETS = 64
_FILES = "file_key string, version long, attempt string"


def submission_stream(spark: SparkSession, src: str, glob: str = "*.txt", max_files: int = 1000) -> DataFrame:
    return submission_rows(
        spark.readStream.format("binaryFile").schema(schemas.SUBMISSION_FILE).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).option("maxFilesPerTrigger", str(max_files)).load(src))


def run_incremental(spark: SparkSession, src: str, out: str, job: Callable[[DataFrame], DataFrame],
                    name: str = "convert", checkpoint: str | None = None, max_files: int = 1000, buckets: int = BUCKETS) -> int:
    """Run ``job`` over files landed since the last run; returns the number of new files.

    ``job`` keeps ``submission_id`` (the file's path).  Read the result with :func:`read_results`.
    """
    ckpt = checkpoint or f"{checkpoint_root(spark).rstrip('/')}/streams/{name}"

    def batch(df: DataFrame, epoch_id: int) -> None:
        commit_batch(df.select("submission_id"), job(df), out, buckets)

    before = _files_seen(spark, ckpt)
    q = (submission_stream(spark, src, max_files=max_files).writeStream.foreachBatch(batch)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return _files_seen(spark, ckpt) - before


def file_key(submission_id: Column) -> Column:
    return F.sha2(submission_id, 256)


def commit_batch(files: DataFrame, rows: DataFrame, out: str, buckets: int = BUCKETS) -> None:
    """Make ``rows`` the rows of ``files`` (both with ``submission_id``): a new version of them all."""
    spark = files.sparkSession
    generation = max(_generations(spark, out, committed=True), default=0)
    version = _listed(spark, out).agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
    _write(files.select(file_key(F.col("submission_id")).alias("file_key")).distinct(), rows, out, generation, version, buckets)


def _write(keys: DataFrame, rows: DataFrame, out: str, generation: int, version: int, buckets: int) -> None:
    attempt = uuid.uuid4().hex
    home = f"{out}/generation={generation}"
    keyed = rows.withColumn("file_key", file_key(F.col("submission_id"))).withColumn("attempt", F.lit(attempt))
    bucket = F.pmod(F.xxhash64("file_key"), F.lit(buckets)).cast("int")
    keyed.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{home}/rows")
    keys.select("file_key", F.lit(version).cast("long").alias("version"), F.lit(attempt).alias("attempt")) \
        .write.mode("append").parquet(f"{home}/files")


def read_results(spark: SparkSession, out: str) -> DataFrame:
    """The newest rows of every file."""
    newest = _listed(spark, out).groupBy("file_key").agg(F.max_by("attempt", F.struct("version", "attempt")).alias("attempt"))
    homes = [f"{out}/generation={g}/rows" for g in _generations(spark, out)]
    homes = [h for h in homes if _has_data(spark, h)]
    if not homes:
        raise FileNotFoundError(f"no rows under {out}")
    rows = None
    for h in homes:                        # one or two: compaction drops what it has replaced
        part = spark.read.parquet(h).drop("bucket")
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(newest, ["file_key", "attempt"], "left_semi").drop("file_key", "attempt")


def compact(spark: SparkSession, out: str, buckets: int = BUCKETS) -> None:
    """Write the newest rows as one generation and drop the older ones.

    The new generation counts once its list of files is written; older ones go after that, so a compaction that is cut off
    at any point loses nothing and can be run again.
    """
    old = _generations(spark, out)
    if not old:
        return
    listed = _listed(spark, out)
    version = listed.agg(F.max("version")).first()[0] or 0
    _write(listed.select("file_key").distinct(), read_results(spark, out), out, max(old) + 1, version + 1, buckets)
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for g in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/generation={g}"), True)


def _generations(spark: SparkSession, out: str, committed: bool = False) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    all_ = sorted(int(n.split("=")[1]) for n in names if n.startswith("generation="))
    return [g for g in all_ if not committed or _has_data(spark, f"{out}/generation={g}/files")]


def _has_data(spark: SparkSession, folder: str) -> bool:
    """Whether a write to the folder was committed (a job that yields no row commits a schema or nothing but its mark)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(path))


def _listed(spark: SparkSession, out: str) -> DataFrame:
    """(file_key, version, attempt) of every committed batch."""
    homes = [f"{out}/generation={g}/files" for g in _generations(spark, out, committed=True)]
    if not homes:
        return spark.createDataFrame([], _FILES)
    return spark.read.schema(_FILES).parquet(*homes)


def _files_seen(spark: SparkSession, ckpt: str) -> int:
    """Entries of the stream's own log of files; the source is not read again."""
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{ckpt}/sources/0")
    fs = log.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(log):
        return 0
    # the log keeps one JSON line per file; compacted batches hold all earlier ones
    lines = spark.read.text(f"{ckpt}/sources/0").filter(F.startswith("value", F.lit("{")))
    return lines.select(F.get_json_object("value", "$.path")).distinct().count()
