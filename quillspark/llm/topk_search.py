"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, in blocks.  Pass by pass, tasks count scores of
each query into ``bins`` equal bins over the query's current range; the counts of
all tasks locate the bin of the k-th best score and the next pass refines that bin alone, until it is one
integer wide: the k-th value.  A last pass keeps the scores above it, and among equals the
smallest ids, which one small window ranks.  A task reports a query's bins from the top down to the one
that holds its own k-th best: the global k-th score cannot be lower, so no count is
missing, and each task reports at most k bins a query and pass.

Queries are taken in runs of ``query_run`` (a proven size: ``query_run`` vectors), so neither the driver nor a task
ever holds them all; candidates are read once for each run and pass and never shuffled.

Vectors become integers floor(256 * x).  Vectors that are null or hold null or non-finite components
take no part, nor do null ids.  Defined cases: every row that repeats an id is a candidate, and a query if its id is one; the
query rows of one id share its k places, and rows of a query's own id are no candidates; vectors are compared with those of their own length only; an empty vector scores 0 with
other empty vectors; fewer than k candidates: all of them; empty tables give no rows; extra
columns are not read.  Scores beyond 64 bits raise ValueError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark._ship import ship_package
from quillspark.llm._blocks import keep

K = 5
SCALE = 256
BINS = 1024
QUERY_RUN = 4096
_CANDIDATES = 2048             # candidate vectors scored at a time


def quantised(vec: Column, scale: int = SCALE) -> Column:
    """array<long> of floor(scale * x); null if any component is null or not finite."""
    x = F.transform(vec, lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.when(vec.isNotNull() & good, F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))))


class _Queries:
    """One run of queries of one length: ids, vectors, and the range where each k-th score lies."""

    def __init__(self, ids, vectors, low, high, exact):
        self.ids, self.vectors, self.low, self.high, self.exact = ids, vectors, low, high, exact

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Integer inner products; floating point where it is exact, which BLAS makes fast."""
        if self.exact:
            return (self.vectors.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
        return self.vectors @ vectors.T


def _blocks_of(batches, size: int):
    """(ids, matrix) of vectors of length ``size``, some thousand at a time."""
    for batch in batches:
        ids, vec = batch.column(0), batch.column(1)
        fits = pc.equal(pc.list_value_length(vec), size)
        ids, vec = ids.filter(fits), vec.filter(fits)
        for a in range(0, len(ids), _CANDIDATES):
            part = vec.slice(a, _CANDIDATES)
            yield (ids.slice(a, _CANDIDATES).to_numpy(zero_copy_only=False),
                   part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), size))


def _bin(scores, low, width):
    return (scores - low[:, None]) // width[:, None]


def _histogram(batches, q: _Queries, k: int, bins: int):
    """Counts by query and bin; scores above the range are counted in one more bin on top."""
    width = -(-(q.high - q.low + 1) // bins)
    counts = np.zeros((len(q.ids), bins + 1), np.int64)
    any_rows = False
    for ids, matrix in _blocks_of(batches, q.vectors.shape[1]):
        any_rows = True
        s = q.scores(matrix)
        b = np.minimum(_bin(s, q.low, width), bins)
        b[(ids[None, :] == q.ids[:, None]) | (s < q.low[:, None])] = -1
        at = (b + np.arange(len(q.ids))[:, None] * (bins + 1))[b >= 0]
        counts += np.bincount(at, minlength=counts.size).reshape(counts.shape)
    if not any_rows:
        return
    down = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]            # scores in this bin or above
    above = down - counts
    row, col = np.nonzero((counts > 0) & (above < k))
    yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)),
                                      pa.array(counts[row, col])], names=["q", "bin", "n"])


def _winners(batches, q: _Queries, k: int):
    """Scores above each query's k-th value (``low``), and the k smallest ids among those equal to it."""
    rows, ids_, scores = [], [], []
    for ids, matrix in _blocks_of(batches, q.vectors.shape[1]):
        s = q.scores(matrix)
        r, c = np.nonzero((s >= q.low[:, None]) & (ids[None, :] != q.ids[:, None]))
        rows.append(r), ids_.append(ids[c]), scores.append(s[r, c])
        if sum(map(len, rows)) > 64 * k * len(q.ids):
            rows, ids_, scores = ([x] for x in _best(rows, ids_, scores, k))
    if rows:
        r, i, s = _best(rows, ids_, scores, k)
        yield pa.RecordBatch.from_arrays([pa.array(q.ids[r]), pa.array(i), pa.array(s)],
                                         names=["query_id", "vec_id", "score"])


def _best(rows, ids, scores, k):
    """The k best of each query of a task: no other of its rows can be among the global k best."""
    r, i, s = np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)
    order = np.lexsort((i, -s, r))
    r, i, s = r[order], i[order], s[order]
    first = np.searchsorted(r, r, side="left")
    top = np.arange(len(r)) - first < k
    return r[top], i[top], s[top]


def _refine(q: _Queries, counts, k: int, bins: int) -> None:
    """Narrow each query's range to the bin of its k-th score; with fewer than k scores, to the lowest score's."""
    width = -(-(q.high - q.low + 1) // bins)
    hist = np.zeros((len(q.ids), bins + 1), np.int64)
    for c in counts:
        hist[c["q"], c["bin"]] = c["n"]
    down = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1]
    reach = down >= np.minimum(k, down[:, 0])[:, None]
    at = reach.shape[1] - 1 - np.argmax(reach[:, ::-1], axis=1)
    at = np.where(down[:, 0] > 0, at, 0)
    inside = at < bins
    q.low = np.where(inside, q.low + at * width, q.low)
    q.high = np.where(inside, np.minimum(q.low + width - 1, q.high), q.low)


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
          scale: int = SCALE, bins: int = BINS, query_run: int = QUERY_RUN) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows by integer inner product of each query row."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vec_col), scale).alias("v"),
                          is_query.alias("is_query"))
    rows = keep(rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("rid", F.monotonically_increasing_id()))
    queries = rows.filter("is_query").select("rid", "vec_id", "v", F.size("v").alias("size"))
    largest = F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0))
    out = None
    for size, most in [(r["size"], r["most"]) for r in rows.groupBy(F.size("v").alias("size")).agg(
            F.max(largest).alias("most")).collect()]:
        limit = max(1, size) * int(most) ** 2
        if limit >= 1 << 62:
            raise ValueError(f"scores of vectors of length {size} can exceed 64 bits")
        same = queries.filter(F.col("size") == size)
        runs = -(-same.count() // query_run)
        for run in range(2 * runs if runs > 1 else runs):
            of_run = same.filter(F.pmod(F.xxhash64("rid"), F.lit(2 * runs)) == run) if runs > 1 else same
            got = of_run.orderBy("vec_id", "rid").select("vec_id", "v").toArrow()
            if not got.num_rows:
                continue
            q = _Queries(got["vec_id"].to_numpy(),
                         got["v"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, size),
                         np.full(got.num_rows, -limit, np.int64), np.full(got.num_rows, limit, np.int64), limit < 1 << 53)
            part = _run(rows.select("vec_id", "v"), q, k, bins)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _run(rows: DataFrame, q: _Queries, k: int, bins: int) -> DataFrame:
    spark = rows.sparkSession
    while int((q.high - q.low).max()) > 0:
        held = spark.sparkContext.broadcast(q)
        counts = rows.mapInArrow(lambda it, held=held: _histogram(it, held.value, k, bins), "q int, bin int, n long")
        _refine(q, counts.groupBy("q", "bin").agg(F.sum("n").alias("n")).collect(), k, bins)
        q = _Queries(q.ids, q.vectors, q.low, q.high, q.exact)
    held = spark.sparkContext.broadcast(q)
    return rows.mapInArrow(lambda it: _winners(it, held.value, k), "query_id long, vec_id long, score long")
