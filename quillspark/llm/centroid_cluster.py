"""Centroid clustering with PCA-rotated filtering.

Integer vectors floor(scale * x) are assigned to the nearest of k integer centroids (squared Euclidean distance, ties to the
smaller number); centroids move to the componentwise floor of the mean of their vectors, for some rounds.

All vectors are rotated once into the principal axes of the table.  Stored with each vector are its ``lead`` leading rotated
coordinates and the norm of the rest (the residual).  For a vector x and a centroid c,

    |x - c|^2  >=  |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2

so most centroids are ruled out by ``lead + 1`` numbers.  The centroid of the least bound is measured first, in integers;
every other centroid whose bound is not above that distance survives and is measured in integers too.  Bounds are floating point and
get a slack far above their rounding error, so results are exact.

Each round is one pass over the stored table; tasks send k rows of sums (pre-aggregated, so a centroid that holds a third of the
rows costs no more).  What the driver holds is k centroids and one ``size`` x ``size`` matrix.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part; a null id takes part but
is never a seed; equal ids tie by vector; with fewer than k seeds there are as many centroids; a centroid without vectors stays where it
is; empty tables give no rows; extra columns are not read.  Components beyond 2^27 raise ValueError, as distances would not
fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark._ship import ship_package
from quillspark.llm._blocks import keep
from quillspark.llm.topk_search import quantised

K = 16
ROUNDS = 3
SCALE = 64
SIZE = 64
LEAD = 12
SEED = "1"
LARGEST = 1 << 27
_SLACK = 1e-6
STORED = "vec_id long, v array<long>, lead array<double>, rest double"
SCHEMA = "vec_id long, cluster int, distance long"


class Rotation:
    """Principal axes of the table: ``axes`` holds the leading ones as columns."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray):
        self.mean, self.axes = mean, axes

    def of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leading coordinates, norm of the rest) of the rows."""
        x = vectors - self.mean
        lead = x @ self.axes
        rest = np.einsum("ij,ij->i", x, x) - np.einsum("ij,ij->i", lead, lead)
        return lead, np.sqrt(np.maximum(rest, 0.0))


def _matrix(column: pa.Array, size: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), size)


def _moments(batches, size: int):
    """One row for each component: its number, and the sums of its products with all (and with 1, and the largest value)."""
    total, most = np.zeros((size + 1, size + 1)), 0
    for batch in batches:
        x = np.column_stack([_matrix(batch.column("v"), size, np.float64), np.ones(batch.num_rows)])
        total += x.T @ x
        most = max(most, int(np.abs(x).max())) if len(x) else most
    if total[-1, -1]:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(total.tolist()),
                                          pa.array(np.full(size + 1, most, np.int64))], names=["i", "sums", "most"])


def _add(table: pa.Table) -> pa.Table:
    sums = np.sum(table["sums"].to_pylist(), axis=0)
    return pa.Table.from_pylist([{"i": table["i"][0].as_py(), "sums": sums.tolist(), "most": pc.max(table["most"]).as_py()}],
                                pa.schema([("i", pa.int32()), ("sums", pa.list_(pa.float64())), ("most", pa.int64())]))


def fit_rotation(rows: DataFrame, size: int, lead: int) -> Rotation | None:
    """Principal axes over all rows; only size + 1 rows of sums reach the driver."""
    sums = rows.select("v").mapInArrow(lambda it: _moments(it, size), "i int, sums array<double>, most long").groupBy(
        "i").applyInArrow(_add, "i int, sums array<double>, most long").collect()
    if not sums:
        return None
    if sums[0]["most"] > LARGEST:
        raise ValueError(f"components beyond {LARGEST} can make distances exceed 64 bits")
    second = np.array([r["sums"] for r in sorted(sums, key=lambda r: r["i"])])
    n = second[-1, -1]
    mean = second[-1, :-1] / n
    values, axes = np.linalg.eigh(second[:-1, :-1] / n - np.outer(mean, mean))
    return Rotation(mean, axes[:, ::-1][:, :lead])


def _store(batches, rotation: Rotation):
    for batch in batches:
        v = batch.column("v")
        lead, rest = rotation.of(_matrix(v, len(rotation.mean), np.float64))
        held = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * lead.shape[1]), pa.array(lead.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), v, held, pa.array(rest)],
                                         names=["vec_id", "v", "lead", "rest"])


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray,
            rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of each vector's nearest centroid, and how many distances were measured."""
    lead_c, rest_c = rotation.of(centroids.astype(np.float64))
    bound = ((lead[:, None, :] - lead_c[None]) ** 2).sum(axis=2) + (rest[:, None] - rest_c[None]) ** 2
    first = bound.argmin(axis=1)
    at = np.arange(len(v))
    best = ((v - centroids[first]) ** 2).sum(axis=1)
    scale = 1.0 + (lead ** 2).sum(axis=1) + rest ** 2 + float((lead_c ** 2).sum(axis=1).max() + (rest_c ** 2).max())
    alive = bound <= (best + _SLACK * scale)[:, None]
    alive[at, first] = False
    row, number = np.nonzero(alive)
    distance = ((v[row] - centroids[number]) ** 2).sum(axis=1)
    number, row = np.concatenate([first, number]), np.concatenate([at, row])
    distance = np.concatenate([best, distance])
    order = np.lexsort((number, distance, row))
    new = np.ones(len(row), bool)
    new[1:] = row[order][1:] != row[order][:-1]
    order = order[new]
    return number[order], distance[order], len(row)


def _assigned(batch, centroids, rotation):
    v = _matrix(batch.column("v"), centroids.shape[1])
    lead = _matrix(batch.column("lead"), rotation.axes.shape[1], np.float64)
    number, distance, _ = nearest(v, lead, batch.column("rest").to_numpy(), centroids, rotation)
    return v, number, distance


def _sums(batches, centroids, rotation):
    """Count and componentwise sum of the vectors of each centroid, one row of a task each."""
    count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for batch in batches:
        if batch.num_rows:
            v, number, _ = _assigned(batch, centroids, rotation)
            count += np.bincount(number, minlength=len(count))
            order = np.argsort(number, kind="stable")
            held, at = np.unique(number[order], return_index=True)
            total[held] += np.add.reduceat(v[order], at, axis=0)
    used = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]),
                                      pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])


def _labels(batches, centroids, rotation):
    for batch in batches:
        if batch.num_rows:
            _, number, distance = _assigned(batch, centroids, rotation)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)],
                                             names=["vec_id", "cluster", "distance"])


def _by_seed(seed: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS,
            size: int = SIZE, scale: int = SCALE, lead: int = LEAD, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every vector that takes part.

    The first centroids are the k vectors of smallest sha256 of ``<seed>:<id>``.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vec_col), scale).alias("v")) \
        .filter(F.size("v") == size)
    first = rows.filter("vec_id IS NOT NULL").orderBy(_by_seed(seed), "v").limit(k).select("v").collect()
    rotation = fit_rotation(rows, size, lead)
    if rotation is None or not first:
        return spark.createDataFrame([], f"{SCHEMA}, cluster_inertia long, inertia long, centroid array<long>")
    turned = spark.sparkContext.broadcast(rotation)
    stored = keep(rows.mapInArrow(lambda it: _store(it, turned.value), STORED))
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        sums = stored.mapInArrow(lambda it, c=centroids: _sums(it, c, turned.value), "cluster int, n long, sums array<long>")
        moved = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(size)])
                                            .alias("sums")).collect()
        centroids = centroids.copy()
        for r in moved:
            centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    labels = keep(stored.mapInArrow(lambda it: _labels(it, centroids, turned.value), SCHEMA))
    inertia = {r["cluster"]: r["s"] for r in labels.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    stats = spark.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), c) for i, c in enumerate(centroids.tolist())],
                                  "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return labels.join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                             "centroid")
