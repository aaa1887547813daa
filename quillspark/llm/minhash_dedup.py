"""MinHash near-dedup by a signature-coordinate inverted join.

A document is the set of its distinct 5-word shingles; two link when 100 * intersection >= 85 * union.  Its signature has ``coords``
coordinates, each the least value of one hash function over the set: two documents agree in a coordinate with
the probability of their similarity, so linked ones agree in ``matches`` coordinates or more: of pairs right at the limit, which
agree in 54 of 64 on average, one in six million has fewer than 38, and above the limit fewer still.

* Equal sets are one node from the start (a 128-bit sum of hashes stands for a set).
* **Posting.** A node is posted under coordinate-value pairs.  Nodes that agree in ``matches`` of ``coords`` pairs share one of
  the first ``coords - matches + 1`` in any common order, the prefix.  The order puts pairs that many nodes have last: long
  lists, which a common line or passage makes, are skipped by all nodes that have enough other pairs.
* **Count.** The signatures under each pair are counted against each other, in bounded parts; two nodes are counted under one of
  their common pairs alone. Nodes without any partner of ``matches`` or more leave; only the others' texts are fetched.
* **First links.** Under each pair the smallest node leads; a node is confirmed with the leader that it collides with most.  This
  gives first components at one confirmation a node.
* **All links.** Where a list still sees several components, its nodes meet with their texts, again in bounded parts: pairs of
  different components that agree in ``matches`` coordinates are confirmed, those that agree most first, until what is linked
  needs no more.  Only links leave a task, never candidates.

Every link is confirmed on the full sets, computed from both texts.  The first links only save work: every link between different
components is looked for under all lists.

Defined cases: texts without words have no shingles and link with nothing; with fewer than 5 words the whole sequence is the one
shingle; repeated rows are equal sets; a null doc_id links as any row does but is a component's id only if no row of it has one
(then null, and kept is null); empty tables give none; extra columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark._ship import ship_package
from quillspark.llm import _blocks as B
from quillspark.llm.components import connected_components
from quillspark.session import checkpoint_root

SHINGLE = 5
PERCENT = 85
COORDS, MATCHES = 64, 38
LONG_SHARE, LONG_ROWS = 1000, 8      # a long list: 1 in 1000 rows; looked for from 8 rows of a task's piece on
PART = 2048                          # nodes of a list whose signatures meet in one piece of work
GROUP = 20_000                       # rows of short lists that one group holds
PART_TEXTS, PART_BYTES = 512, 4 << 20          # nodes, and bytes, of a list that meet with their texts
GROUP_BYTES = 8 << 20
VERIFY_BYTES = 6 << 20
SIGNED = "doc_id long, n_shingles long, node binary, signature binary, text string"


def sets_of(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of them) of the distinct shingles of each text, sorted within a text."""
    flat, n = B.split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    code = flat.dictionary_encode()
    words = code.dictionary.cast(pa.string()).to_pylist()
    h = B.word_hashes(words)[code.indices.to_numpy(zero_copy_only=False)] if words else np.zeros(0, np.uint64)
    grams, end, parts = B.window_hashes(h, k), np.cumsum(n), []
    for a, b in zip((end - n).tolist(), end.tolist(), strict=True):
        if b - a >= k:
            parts.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            parts.append(B.mix(B.window_hashes(h[a:b], b - a) + np.uint64(b - a)))
        else:
            parts.append(np.zeros(0, np.uint64))
    return np.concatenate(parts or [np.zeros(0, np.uint64)]), np.array([len(p) for p in parts], np.int64)


def _seeds(coords: int) -> tuple[np.ndarray, np.ndarray]:
    x = B.mix(np.arange(1, 2 * coords + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:coords], x[coords:] | np.uint64(1)


def signatures(keys: np.ndarray, n: np.ndarray, coords: int) -> np.ndarray:
    """One row for each set that is not empty: the least value (32 bits) of every hash function."""
    start = (np.cumsum(n) - n)[n > 0]
    out = np.zeros((len(start), coords), np.uint32)
    if len(start):
        for c, (flip, by) in enumerate(zip(*_seeds(coords), strict=True)):
            x = (keys ^ flip) * by
            x ^= x >> np.uint64(29)
            out[:, c] = np.minimum.reduceat((x * by) >> np.uint64(32), start)
    return out


def pair_keys(signature: np.ndarray) -> np.ndarray:
    """64-bit key of each coordinate-value pair, without loss: the coordinate above the value."""
    return (np.arange(signature.shape[1], dtype=np.int64) << 32) | signature.astype(np.int64)


def prefixes(signature: np.ndarray, long_keys: np.ndarray, length: int) -> np.ndarray:
    """For each row, which coordinates belong to its prefix: pairs of long lists come last."""
    late = np.isin(pair_keys(signature), long_keys)
    rank = np.argsort(np.argsort(late, axis=1, kind="stable"), axis=1, kind="stable")
    return rank < length


def _matrix(column) -> np.ndarray:
    """Signatures of the rows (one at least)."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _signed(batches, k: int, coords: int):
    for run in B.text_runs(batches):
        run = run.combine_chunks()
        if not run.num_rows:
            continue
        ids, texts = run.column(0).chunk(0), run.column(1).chunk(0)
        keys, n = sets_of(texts, k)
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in
                (B.mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)), B.mix(keys * np.uint64(3) + np.uint64(1)))]
        end = np.cumsum(n)
        node = np.stack([c[end] - c[end - n] for c in sums], axis=1)
        full = np.flatnonzero(n > 0)
        signature = dict(zip(full.tolist(), signatures(keys, n, coords), strict=True))
        yield pa.RecordBatch.from_arrays([
            ids, pa.array(n), pa.array([node[i].tobytes() if n[i] else None for i in range(len(n))], pa.binary()),
            pa.array([signature[i].tobytes() if n[i] else None for i in range(len(n))], pa.binary()), texts],
            names=["doc_id", "n_shingles", "node", "signature", "text"])


def _frequent(batches):
    """Pairs that many nodes of a batch have."""
    for batch in batches:
        if batch.num_rows:
            key, n = np.unique(pair_keys(_matrix(batch.column(0))), return_counts=True)
            often = n >= max(LONG_ROWS, batch.num_rows // (2 * LONG_SHARE))
            yield pa.RecordBatch.from_arrays([pa.array(key[often]), pa.array(n[often])], names=["key", "n"])


def _posted(batches, long_keys, length: int):
    for batch in batches:
        if batch.num_rows:
            s = _matrix(batch.column("signature"))
            key = pair_keys(s)[prefixes(s, long_keys, length)].reshape(len(s), length)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.ListArray.from_arrays(
                pa.array(np.arange(len(s) + 1, dtype=np.int32) * length), pa.array(key.ravel()))], names=["rid", "keys"])


def _counted(s: np.ndarray, left: np.ndarray, right: np.ndarray, itself: bool, matches: int):
    """(row, row, count) of pairs that agree in ``matches`` coordinates, 256 rows against all at a time."""
    for a in range(0, len(left), 256):
        x, y = left[a:a + 256], right[a:] if itself else right
        count = np.zeros((len(x), len(y)), np.uint8)
        for c in range(s.shape[1]):
            count += s[x, c][:, None] == s[y, c][None, :]
        i, j = np.nonzero(count >= matches)
        n = count[i, j]
        i, j = x[i], y[j]
        ok = i < j if itself else np.ones(len(i), bool)
        yield i[ok], j[ok], n[ok]


class Lists:
    """The lists, or pairs of parts of a list, that one group holds."""

    def __init__(self, table: pa.Table, matches: int, long_keys, signature=None):
        self.table = table
        self.key, self.rid, side = (table[c].to_numpy() for c in ("key", "rid", "side"))
        self.s = signature if signature is not None else _matrix(table["signature"])
        self.matches = matches
        self.in_prefix = prefixes(self.s, long_keys, self.s.shape[1] - matches + 1)
        self.keys = pair_keys(self.s)
        i, j = table["i"].to_numpy(), table["j"].to_numpy()
        cut = np.flatnonzero((self.key[1:] != self.key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        self.pieces = []
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(self.key)], strict=True):
            rows, itself = np.arange(lo, hi), bool(i[lo] == j[lo])
            self.pieces.append((rows, rows, True) if itself else
                               (rows[side[lo:hi] == 0], rows[side[lo:hi] == 1], False))

    @staticmethod
    def sorted(table: pa.Table) -> pa.Table:
        return table.sort_by([(c, "ascending") for c in ("key", "i", "j", "side", "rid")])

    def pairs(self):
        """(row, row, count) of each piece's pairs that are counted here: under the first pair that both prefixes have."""
        none = np.iinfo(np.int64).max
        for left, right, itself in self.pieces:
            for i, j, n in _counted(self.s, left, right, itself, self.matches):
                for a in range(0, len(i), 1 << 16):
                    x, y = i[a:a + (1 << 16)], j[a:a + (1 << 16)]
                    both = (self.s[x] == self.s[y]) & self.in_prefix[x] & self.in_prefix[y]
                    here = np.where(both, self.keys[x], none).min(axis=1) == self.key[x]
                    yield x[here], y[here], n[a:a + (1 << 16)][here]


def _partnered(table: pa.Table, matches: int, long_keys) -> pa.Table:
    """(key, rid) of nodes with a partner."""
    lists = Lists(Lists.sorted(table), matches, long_keys)
    used = np.zeros(table.num_rows, bool)
    for i, j, _ in lists.pairs():
        used[i] = used[j] = True
    return pa.table({"key": pa.array(lists.key[used]), "rid": pa.array(lists.rid[used])})


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _tied(table: pa.Table, k: int, percent: int, coords: int, matches: int, long_keys) -> pa.Table:
    """Confirmed links that tie the components of one group's lists together."""
    table = Lists.sorted(table)
    sets, n = sets_of(table["text"].combine_chunks().cast(pa.string()), k)
    end = np.cumsum(n)
    lists = Lists(table, matches, long_keys, signatures(sets, n, coords))
    _, root = np.unique(table["label"].to_numpy(), return_inverse=True)
    parent = list(range(int(root.max()) + 1))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    links = []
    for i, j, count in lists.pairs():
        now = np.array([find(r) for r in range(len(parent))])[root]
        open_ = np.flatnonzero(now[i] != now[j])
        for at in open_[np.argsort(-count[open_].astype(int), kind="stable")].tolist():
            x, y = int(i[at]), int(j[at])
            a, b = find(root[x]), find(root[y])
            if a != b and _linked(sets[end[x] - n[x]:end[x]], sets[end[y] - n[y]:end[y]], percent):
                parent[max(a, b)] = min(a, b)
                links.append((int(lists.rid[x]), int(lists.rid[y])))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _confirmed(batches, k: int, percent: int):
    """Links among candidate pairs (a, b, x, y), on the full sets of both texts."""
    size = lambda b: np.add(*[pc.binary_length(b.column(i)).to_numpy(zero_copy_only=False) for i in (2, 3)])
    for run in B._slices(batches, size, VERIFY_BYTES):
        run = run.combine_chunks()
        keys, n = sets_of(pa.concat_arrays([run.column(c).chunk(0).cast(pa.string()) for c in (2, 3)]), k)
        end, m = np.cumsum(n), run.num_rows
        ok = np.zeros(m, bool)
        for i in range(m):
            x, y = keys[end[i] - n[i]:end[i]], keys[end[i + m] - n[i + m]:end[i + m]]
            ok[i] = _linked(x, y, percent)
        yield pa.RecordBatch.from_arrays([run.column(c).chunk(0).filter(pa.array(ok)) for c in (0, 1)], names=["a", "b"])


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    one = texts.select(F.col("rid").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("rid").alias("b"), F.col("text").alias("y"))
    return B.keep(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(
        lambda it: _confirmed(it, k, percent), "a long, b long"))


def _grouped(lists: DataFrame, parts: Column, groups: Column) -> DataFrame:
    """Lists cut into ``parts`` of which every two meet once (part i is side 0, j is side 1), and dealt to groups of work:
    a pair of parts is one group, whole lists share ``groups``."""
    cut = lists.withColumn("parts", parts.cast("int")).withColumn("part", F.pmod(F.xxhash64("rid"), "parts").cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(
        F.least("part", o).alias("i"), F.greatest("part", o).alias("j"), (o < F.col("part")).cast("int").alias("side")))
    out = cut.withColumn("at", F.explode(meet)).select("*", "at.*").drop("at", "part")
    work = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("key"), groups)).otherwise(F.xxhash64("key", "i", "j"))
    return out.withColumn("work", work).drop("parts")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT, coords: int = COORDS, matches: int = MATCHES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; kept: the row has its component's id."""
    spark = docs.sparkSession
    ship_package(spark)
    length = coords - matches + 1
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    folder = f"{checkpoint_root(spark)}/signed-{uuid.uuid4().hex}"
    texts.mapInArrow(lambda it: _signed(it, shingle, coords), SIGNED).withColumn(
        "row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    signed = spark.read.parquet(folder)
    nodes = signed.filter("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct("row", "signature")).alias("first"), F.min("doc_id").alias("low"))
    nodes = B.keep(nodes.select("node", F.col("first.row").alias("rid"), F.col("first.signature").alias("signature"), "low"))
    n = nodes.count()
    often = nodes.select("signature").mapInArrow(lambda it: _frequent(it), "key long, n long").groupBy("key").agg(
        F.sum("n").alias("n")).filter(F.col("n") * LONG_SHARE >= n).select("key").toArrow()     # at most coords * LONG_SHARE
    long_keys = spark.sparkContext.broadcast(np.sort(often["key"].to_numpy()))
    posted = nodes.select("rid", "signature").mapInArrow(
        lambda it: _posted(it, long_keys.value, length), "rid long, keys array<long>")
    posted = posted.select("rid", F.explode("keys").alias("key"))
    heads = posted.groupBy("key").agg(F.count("*").alias("m"), F.min("rid").alias("leader")).filter("m > 1")
    lists = B.keep(posted.join(heads, "key"))
    B.release(spark)
    groups = F.lit(lists.count() // GROUP + 1)
    partnered = B.keep(_grouped(lists.drop("leader"), F.ceil(F.col("m") / PART), groups).drop("m").join(
        nodes.select("rid", "signature"), "rid").groupBy("work").applyInArrow(
        lambda t: _partnered(t, matches, long_keys.value), "key long, rid long").distinct())
    held = B.keep(signed.select(F.col("row").alias("rid"), "text").join(
        partnered.select("rid").distinct(), "rid", "left_semi"))
    B.release(spark)
    # the leader that a node collides with most, if under half of the prefix
    met = lists.filter("rid <> leader").groupBy("rid", "leader").agg(F.count("*").alias("n")) \
        .filter(F.col("n") * 2 >= length).groupBy("rid").agg(F.max(F.struct("n", "leader")).alias("most"))
    links = _confirm(met.select(F.col("most.leader").alias("a"), F.col("rid").alias("b")), held, shingle, percent)
    labels = connected_components(links).withColumnRenamed("node", "rid")
    full = partnered.join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    several = full.join(held.select("rid", F.octet_length("text").alias("bytes")), "rid").groupBy("key").agg(
        F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("m"), F.sum("bytes").alias("bytes")) \
        .filter("l0 <> l1").select("key", "m", "bytes")
    left = B.keep(full.join(several, "key"))
    B.release(spark)
    size = left.agg(F.sum(F.col("bytes") / F.col("m"))).first()[0] or 0
    parts = F.ceil(F.greatest(F.col("m") / PART_TEXTS, F.col("bytes") / PART_BYTES))
    tied = B.keep(_grouped(left, parts, F.lit(int(size) // GROUP_BYTES + 1)).drop("m", "bytes").join(held, "rid").groupBy("work")
                  .applyInArrow(lambda t: _tied(t, shingle, percent, coords, matches, long_keys.value), "a long, b long"))
    links = links.unionByName(tied)
    member = nodes.select("node", "rid", "low").join(connected_components(links).withColumnRenamed("node", "rid"), "rid", "left") \
        .withColumn("label", F.coalesce("label", "rid"))
    lowest = member.groupBy("label").agg(F.min("low").alias("component_id"))
    member = member.join(lowest, "label").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", "node").join(member, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
