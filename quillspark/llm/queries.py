"""Registered queries of the ten operators: ``opN_<name>(spark, sf_dir)`` and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.lm_score import score_documents
    return score_documents(table(spark, sf_dir, "documents"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.topk_search import top_k
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.url_filter import filter_urls
    return filter_urls(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.bpe import encode_decode
    return encode_decode(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import toxicity as t
    docs = table(spark, sf_dir, "documents")
    out = t.score(docs, t.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", t.held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= t.THRESHOLD).cast("int").alias("predicted"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.pii_surrogates import replace_entities
    out = replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"),
                      F.transform("entities", lambda e: F.concat(e["kind"], F.lit(":"), e["surrogate"]))
                      .alias("entities"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.decontaminate import find_hits
    out = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.jaccard_join import component_ids
    return component_ids(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.substring_dedup import dedup_substrings
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words",
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.secret_scan import scan_secrets, span_text
    out = scan_secrets(table(spark, sf_dir, "documents"))

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return out.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(span_text(of("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """The contract's input of op 11: in one text of ten by a hash of its id, the words from ``a`` on repeat the p words from
    there (h = crc32 of the id, g = floor(h / 10), a = g % n, p = 1 + floor((n - a) / (3 + g % 8)))."""
    from quillspark.functions.text import let
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = F.pmod(g, n)
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        tail = F.transform(words, lambda w, i: F.get(words, place(i).cast("int")))
        return F.when(n > 0, F.array_join(tail, " ")).otherwise(F.lit(""))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), let(words, repeated))
                           .otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.periodic_runs import by_order, periodic_runs
    out = periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.get(F.array_sort("runs", lambda a, b: by_order(
        (b["length"] * a["period"], a["length"] * b["period"]), (a["start"], b["start"]), (a["period"], b["period"]))), 0)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[
        r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}") for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"))


def op12_centroid_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.centroid_cluster import cluster
    return cluster(table(spark, sf_dir, "embeddings")).withColumn(
        "centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)).drop("centroid")


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.minhash_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_topk_search": op2_topk_search,
    "op3_url_filter": op3_url_filter,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_decontaminate": op7_decontaminate,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_centroid_cluster": op12_centroid_cluster,
    "op13_minhash_dedup": op13_minhash_dedup,
}

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

#: Every window of every item against every position of every document, by a hash join on the text.
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s
    FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

OP2_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_RAW = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All sets that share a shingle, exact overlaps, and the closure of links.
_SET_LINKS = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_RAW.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[p:p + 4], ' ') AS k
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS both FROM s a JOIN s b ON a.k = b.k AND a.r <> b.r GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.r = c.a JOIN n y ON y.r = c.b
  WHERE 100 * c.both >= PERCENT * (x.n + y.n - c.both)),
g AS (SELECT r AS a, r AS b FROM d UNION SELECT g.a, l.b FROM g JOIN l ON l.a = g.b),
m AS (SELECT g.a AS r, min(d.doc_id) AS component_id FROM g JOIN d ON d.r = g.b GROUP BY g.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_idMORE
FROM d LEFT JOIN n USING (r) JOIN m USING (r)
"""
OP8_SQL = _SET_LINKS.replace("PERCENT", "75").replace("MORE", "")
OP13_SQL = _SET_LINKS.replace("PERCENT", "85").replace("MORE", ", d.doc_id = m.component_id AS kept")

#: Every window of 13 words with the smallest doc_id that it starts in.
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_RAW.format("coalesce(text, '')")} AS w FROM documents),
v AS (SELECT r, doc_id, p, array_to_string(w[p:p + 12], ' ') AS k
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
f AS (SELECT k, min(doc_id) AS low FROM v GROUP BY k),
x AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS p FROM v JOIN f USING (k) WHERE low < doc_id),
t AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
o AS (SELECT t.r, count(x.p) AS n_removed, string_agg(CASE WHEN x.p IS NULL THEN t.word END, ' ' ORDER BY t.p) AS kept
  FROM t LEFT JOIN x ON x.r = t.r AND x.p = t.p GROUP BY t.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (r)
"""



def _op12_sql(rounds: int = 3) -> str:
    """Seeds by hash, then rounds of nearest centroid by integer distance and exact floors of the means."""
    nearest = """
a{r} AS (SELECT row, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (
  SELECT row, c, CAST(list_sum(list_transform(range(1, 65), lambda i: (e.v[i] - m.v[i]) * (e.v[i] - m.v[i]))) AS BIGINT) AS d
  FROM e, m{r} AS m) GROUP BY row),"""
    move = """
s{r} AS MATERIALIZED (SELECT c, i, floor_div(sum(x), count(*)) AS x FROM (
  SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{r} JOIN e USING (row)) GROUP BY c, i),
m{n} AS MATERIALIZED (SELECT m{r}.c, coalesce(t.v, m{r}.v) AS v FROM m{r} LEFT JOIN
  (SELECT c, list(CAST(x AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c) AS t USING (c)),"""
    floor = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
    steps = "".join(nearest.format(r=r) + (move.format(r=r, n=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id,
    list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
m0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM e
  WHERE vec_id IS NOT NULL ORDER BY c LIMIT 16),{steps.replace("floor_div(sum(x), count(*))", floor)}
i AS (SELECT c, CAST(sum(d) AS BIGINT) AS n FROM a{rounds} GROUP BY c)
SELECT vec_id, c AS cluster, d AS distance, i.n AS cluster_inertia, CAST((SELECT sum(n) FROM i) AS BIGINT) AS inertia,
  sha256(array_to_string(m{rounds}.v, ',')) AS centroid_sha256
FROM e JOIN a{rounds} USING (row) JOIN i USING (c) JOIN m{rounds} USING (c)
"""


ORACLE: dict[str, str] = {
    "op12_centroid_cluster": _op12_sql(),
    "op13_minhash_dedup": OP13_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op2_topk_search": OP2_SQL,
    "op7_decontaminate": OP7_SQL,
}
