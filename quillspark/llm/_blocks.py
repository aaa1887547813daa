"""Blocks of tokenised documents and hash-sharded question rounds over them.

A *block* packs some MB of consecutive documents into one row: the words of its
documents as ids into the block's own word list.  An operator that needs corpus-wide
knowledge of keys (words, word windows, shingles) asks in *rounds*:

1. ``ask``: each block writes its distinct keys once, grouped by shard (a hash of
   the key), so a key that fills a third of the corpus costs one entry per block;
2. ``answer``: one task per shard merges the blocks' entries and replies to every
   block in the order of its entries;
3. ``tell``: the replies meet the block again (shuffle on the block number).

Every step is a Spark job over rows (``mapInArrow``, ``groupBy().applyInArrow``,
``cogroup``); blocks and replies are checkpointed in ``spark.checkpoint.dir`` so that a lost
executor replays one task instead of the whole chain.
"""

from __future__ import annotations

import gc

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark._ship import ship_package
from quillspark.session import checkpoint_root

BLOCK_BYTES = 12 << 20       # text bytes of a block; one longer document is a block alone
SHARD_WORDS = 2 << 20        # words of input per shard of a round
BLOCK_SCHEMA = "block long, doc array<long>, n array<int>, tok binary, words binary"
ASK_SCHEMA = "shard int, block long, data binary"
ANSWER_SCHEMA = "shard int, block long, data binary, total long, kinds long"
_SECOND_KEY = "fedcba9876543210"


def keep(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark) -> None:
    """Let Spark's cleaner remove shuffle files and checkpoints that no live frame reaches any more.

    The cleaner acts when the driver's JVM collects garbage, which an idle driver hardly does; without this the
    files of every finished round stay on the executors' disks until the job ends.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one byte string, compressed byte plane by byte plane (ids and counts use few of their bytes)."""
    head, planes = [len(arrays)], []
    for a in arrays:
        head += [ord(a.dtype.char), len(a)]
        planes.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T))
    raw = np.array(head, np.int64).tobytes() + b"".join(p.tobytes() for p in planes)
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(data[:8], np.int64)[0])
    raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    head = np.frombuffer(raw[8:8 + 16 * n], np.int64).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for kind, length in head:
        dtype = np.dtype(chr(int(kind)))
        planes = np.frombuffer(raw, np.uint8, int(length) * dtype.itemsize, at).reshape(dtype.itemsize, int(length))
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += int(length) * dtype.itemsize
    return out


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` in order, and how many each text has (null: none)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = pc.list_flatten(lists)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    per = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(per)
    kept = np.concatenate([[0], np.cumsum(full)])
    n = kept[ends] - kept[ends - per]
    return (flat if full.all() else flat.filter(pa.array(full))), n


def _slices(batches, size_of, limit):
    """Record batches cut into runs of rows of up to ``limit`` bytes (one row at least)."""
    held, held_bytes = [], 0
    for batch in batches:
        sizes, at = size_of(batch), 0
        for i, b in enumerate(sizes):
            if held_bytes + b > limit and (held or i > at):
                if i > at:
                    held.append(batch.slice(at, i - at))
                yield pa.Table.from_batches(held)
                held, held_bytes, at = [], 0, i
            held_bytes += int(b)
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def text_runs(batches, limit: int = BLOCK_BYTES, at: int = 1):
    """Tables of bounded text size (column ``at``) from a stream of record batches."""
    return _slices(batches, lambda b: pc.fill_null(pc.binary_length(b.column(at)), 0).to_pylist(), limit)


def _make_blocks(batches, lower: bool, limit: int):
    part = TaskContext.get().partitionId()
    for k, run in enumerate(text_runs(batches, limit)):
        run = run.combine_chunks()
        texts = run.column(1).chunk(0) if run.num_rows else pa.array([], pa.string())
        flat, n = split_words(pc.ascii_lower(texts) if lower else texts)
        code = flat.dictionary_encode()
        words = code.dictionary.cast(pa.string()).to_pylist()
        yield pa.RecordBatch.from_arrays([
            pa.array([(part << 32) + k], pa.int64()),
            pa.array([run.column(0).to_pylist()], pa.list_(pa.int64())),
            pa.array([n.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([pack(code.indices.to_numpy(zero_copy_only=False).astype(np.int32),
                           level=3)], pa.binary()),
            pa.array([pack(np.frombuffer(" ".join(words).encode(), np.uint8), level=3)], pa.binary()),
        ], names=["block", "doc", "n", "tok", "words"])


def token_blocks(df: DataFrame, id_col: str, text_col: str, lower: bool,
                 block_bytes: int = BLOCK_BYTES, placed: bool = False) -> DataFrame:
    """One row per block of documents; other columns of ``df`` are not read.

    ``placed``: blocks are dealt out by number before they are kept, and what meets them later comes to where they are.
    """
    ship_package(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = rows.mapInArrow(lambda it: _make_blocks(it, lower, block_bytes), BLOCK_SCHEMA)
    if not placed:
        return keep(blocks)
    conf, adaptive = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    held = conf.get(adaptive)
    conf.set(adaptive, "false")               # a checkpoint of an adaptive plan forgets how its rows are dealt out
    try:
        return keep(blocks.repartition(int(conf.get("spark.sql.shuffle.partitions")), "block"))
    finally:
        conf.set(adaptive, held)


class Block:
    """A block inside a task."""

    def __init__(self, table: pa.Table):
        row = table.slice(0, 1)
        self.number = row["block"][0].as_py()
        doc = row["doc"].combine_chunks().flatten()
        self.null = doc.is_null().to_numpy(zero_copy_only=False)
        self.doc = pc.fill_null(doc, 0).to_numpy(zero_copy_only=False)
        self.n = row["n"].combine_chunks().flatten().to_numpy().astype(np.int64)
        self.tok = unpack(row["tok"][0].as_py())[0]
        text = unpack(row["words"][0].as_py())[0].tobytes().decode()
        self.words = text.split(" ") if text else []
        self.start = np.concatenate([[0], np.cumsum(self.n)])

    def hashes(self, second: bool = False) -> np.ndarray:
        """64-bit hash of each word of the block's list."""
        return word_hashes(self.words, second)

    def row_of(self) -> np.ndarray:
        """Row number (in the block) of each word position."""
        return np.repeat(np.arange(len(self.n)), self.n)


def word_hashes(words: list[str], second: bool = False) -> np.ndarray:
    a = np.array(words, dtype=object)
    return pd.util.hash_array(a, hash_key=_SECOND_KEY, categorize=False) if second else \
        pd.util.hash_array(a, categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (in place on a copy)."""
    x = x.astype(np.uint64, copy=True)
    for shift, mul in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mul)
    x ^= x >> np.uint64(33)
    return x


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (the last k - 1 positions are left out)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j:j + m]
    return mix(out)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a 64-bit hash; sorted hashes have sorted shards."""
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def shard_count(blocks: DataFrame) -> int:
    """Shards of a round: by the number of words, at least the session's shuffle partitions."""
    words = blocks.select(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words // SHARD_WORDS))


def rows_by_shard(number: int, shard: np.ndarray, parts) -> list[tuple]:
    """(shard, block, data) for sorted ``shard``; ``parts(lo, hi)`` packs the entries lo..hi."""
    edges = np.flatnonzero(np.diff(shard)) + 1
    lo = np.concatenate([[0], edges]) if len(shard) else []
    hi = np.concatenate([edges, [len(shard)]]) if len(shard) else []
    return [(int(shard[a]), number, parts(int(a), int(b))) for a, b in zip(lo, hi, strict=True)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


_ASK = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
_ANSWER = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("data", pa.binary()),
                     ("total", pa.int64()), ("kinds", pa.int64())])


def entries(rows: list[tuple]) -> pa.Table:
    """Rows (shard, block, data) of a round as a table."""
    return _table(rows, _ASK)


def ask(blocks: DataFrame, fn) -> DataFrame:
    """``fn(block) -> [(shard, block, data)]`` over blocks alone."""
    def run(it):
        for batch in it:
            for i in range(batch.num_rows):
                t = _table(fn(Block(pa.Table.from_batches([batch.slice(i, 1)]))), _ASK)
                yield from t.to_batches()
    return blocks.mapInArrow(run, ASK_SCHEMA)


def ask_again(blocks: DataFrame, answers: DataFrame, fn) -> DataFrame:
    """``fn(block, replies) -> [(shard, block, data)]`` over blocks and earlier replies."""
    return tell(blocks, answers, lambda b, r: _table(fn(b, r), _ASK), ASK_SCHEMA)


def answer(asks: DataFrame, fn) -> DataFrame:
    """``fn([data]) -> ([reply], total, kinds)`` per shard; the two sums stand on one row of the shard."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        replies, total, kinds = fn([d.as_py() for d in table["data"]])
        return _table([(s.as_py(), b.as_py(), r, total if i == 0 else 0, kinds if i == 0 else 0)
                       for i, (s, b, r) in enumerate(zip(table["shard"], table["block"], replies, strict=True))],
                      _ANSWER)
    spark = asks.sparkSession
    out = keep(asks.groupBy("shard").applyInArrow(run, ANSWER_SCHEMA))
    del asks
    release(spark)
    return out


def bit_replies(bits: np.ndarray, asked: list) -> list[bytes]:
    """One bit per asked key, cut by block."""
    out, at = [], 0
    for a in asked:
        out.append(pack(np.packbits(bits[at:at + len(a[0])]), np.array([len(a[0])])))
        at += len(a[0])
    return out


def bits(replies) -> np.ndarray:
    """The bits of all shards in the order of the block's sorted keys."""
    parts = [unpack(r) for r in replies]
    return np.concatenate([np.unpackbits(p[0], count=int(p[1][0])) for p in parts] or [np.zeros(0, np.uint8)]) \
        .astype(bool)


def ask_shared(block: Block, keys: np.ndarray, several: np.ndarray, shards: int) -> list[tuple]:
    """Entries for distinct sorted 64-bit keys; ``several``: the block holds the key twice itself."""
    return rows_by_shard(block.number, shard_of(keys, shards),
                         lambda a, b: pack(keys[a:b], np.packbits(several[a:b])))


def answer_shared(datas):
    """Reply to :func:`ask_shared`: whether a key occurs in several blocks or several times in one."""
    asked = [unpack(d) for d in datas]
    keys = np.concatenate([a[0] for a in asked])
    several = np.concatenate([np.unpackbits(a[1], count=len(a[0])) for a in asked])
    u, inv, n = np.unique(keys, return_inverse=True, return_counts=True)
    shared = (n > 1) | (np.bincount(inv, weights=several, minlength=len(u)) > 0)
    return bit_replies(shared[inv], asked), len(keys), len(u)


def tell(blocks: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(block, [reply of each shard, in order]) -> pa.Table`` for each block."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("shard", "ascending")])
        return fn(Block(left), [d.as_py() for d in right["data"]])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def tell_both(blocks: DataFrame, first: DataFrame, second: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(block, replies of round 1, replies of round 2) -> pa.Table``; blocks meet both in one shuffle."""
    shift = 1 << 30
    both = first.unionByName(second.withColumn("shard", F.col("shard") + F.lit(shift)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("shard")
        data, cut = [d.as_py() for d in right["data"]], sum(x < shift for x in right["shard"].to_pylist())
        return fn(Block(left), data[:cut], data[cut:])
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(run, schema)
