"""Corpus pipeline over ``documents`` (part of subpackage llm): five stages, each over all that the one before kept.

1. toxicity: documents that score ``THRESHOLD`` or more go;
2. n-gram Jaccard join: of each group of linked documents one stays, the first by doc_id (null last) and hash of the row;
3. benchmark decontamination: documents that hold a window of a benchmark item go;
4. secret scan: secrets in texts are replaced by a mark, documents stay;
5. BPE: the ids of every document.

Stage 2 tells rows apart by all their columns, so repeated and null doc_ids take part like others; rows without words
link to nothing and stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, jaccard_join, secret_scan, toxicity
from quillspark.session import checkpoint_root


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = "__qs_row"
    # a hash of the whole row (nulls told from values): doc_ids may repeat or be null
    keyed = docs.withColumn(key, F.xxhash64(*[x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]))
    has_words = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    worded = keyed.filter(has_words)
    # with that hash as id, the smallest id of a component is the component's own
    ids = jaccard_join.component_ids(worded, id_col=key).select(F.col("doc_id").alias(key), "component_id").distinct()
    first = ids.join(worded.select(key, "doc_id").distinct(), key).groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", key)).alias("first")).select(f"first.{key}")
    one = worded.join(first, key, "left_semi").dropDuplicates([key])
    return one.select(docs.columns).unionByName(docs.filter(~has_words))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mark = "__qs_text_hash"
    marked = docs.withColumn(mark, F.xxhash64("text"))
    hits = decontaminate.find_hits(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=[mark]) \
        .filter("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col(mark).alias("hit_hash")).distinct()
    same = marked["doc_id"].eqNullSafe(hits["hit_id"]) & (marked[mark] == hits["hit_hash"])
    return marked.join(hits, same, "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs).select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("bpe", encode),
]

#: The toxicity model is trained, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
