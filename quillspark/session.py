"""Session construction and shared-storage helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on; callers on a cluster pass their own master and
# keep the cluster's shuffle-partition count.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows hold whole documents (several MB each): keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "quillspark",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting comes from the cluster; ``fallback`` is only for
    tests and local runs where it is unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if fallback is None:
            raise RuntimeError("spark.checkpoint.dir is not set; pass a shared folder")
        root = fallback
        spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
