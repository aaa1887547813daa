"""Connected components of a link table, by Spark joins (never on the driver)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._blocks import keep, release


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): label is the smallest node of its component.

    Links are turned into stars by alternating two steps, which takes a logarithmic number of rounds in practice: every
    node ties its larger neighbours to its smallest neighbour, then its smaller neighbours and itself.  A step is one
    minimum, pre-aggregated before its shuffle, and one join.  Before each round the links that a task holds
    are thinned to a spanning forest of stars.
    """
    edges, seen = keep(_thin(links.select("a", "b").filter("a <> b"))), None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == seen:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = keep(_thin(small.unionByName(least.select(F.col("m").alias("a"), "b"))))
        del both, least, large, small
        release(edges.sparkSession)
    return keep(edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()))


def _thin(links: DataFrame) -> DataFrame:
    return links.mapInArrow(_stars, "a long, b long").distinct()


def _stars(batches):
    """The links of a task, some hundred thousand at a time, as (smallest node, node) of their components."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars():
        nodes = [x for x in parent if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())],
                                          names=["a", "b"])
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield stars()
            parent.clear()
    yield stars()


HELD = 500_000                # nodes that a task thins together
