"""Periodic run detection by scale-tiled distribution.

A *run* is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
``max(least, times * q)`` words that no neighbouring word extends.  In terms of matches (positions i whose word is that of i + q) it is
a maximal interval of at least ``(times - 1) * q`` matches.

Each document is exploded into tiles by octave: the tiles of octave P (1, 2, 4, ...) answer for the periods P <= q < 2P.  A
tile has a cell of P words that starts at a multiple of P, and reaches P words before and 3P words behind that cell, so neighbours
overlap.  An interval of three or more periods holds at least two whole neighbouring cells, therefore:

1. a tile asks which q match its whole cell: first by a hash of the cell's first and last words, for all tiles of an octave
   in one array operation, then by the Z-functions at the cell's boundary, forward (matches from the cell's start on) and
   backward (matches before it).  Both end within the tile, so tiles are solved independently, in linear time each;
2. a period whose word is a power of a shorter word is the shorter period's affair and is left out;
3. what is left, interval fragments, is shuffled by document and period and stitched where fragments touch.  Fragments are few:
   one per whole cell of a real repetition.

A task holds some MB of text at a time and one tile's Z-functions; the tables between the steps are in the shared folder.

Defined cases: a null or empty text has no words and no run; a text shorter than ``least`` words has no run; repeated rows are
separate documents; null ids are kept; empty tables give none; extra columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark._ship import ship_package
from quillspark.llm import _blocks as B
from quillspark.session import checkpoint_root

LEAST = 6                 # words of a run at least
TIMES = 4                 # periods of a run at least
GRAM = 8                  # words of a cell compared by hash, at each of its ends
_FRAGMENT = pa.struct([("period", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
_RUNS = "array<struct<start:long,length:long,period:long>>"
SOLVED = "doc_id long, n_words long, words string, fragments array<struct<period:int,start:int,stop:int>>"
SCHEMA = f"doc_id long, n_words long, runs {_RUNS}, kept_text string"


def z_function(s: list, upto: int) -> list:
    """For each i < upto how many items from i on equal those from the start on (the first entry is 0)."""
    n, z = len(s), [0] * min(upto, len(s))
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def solve_tile(words: list, cell: int, size: int, periods) -> list[tuple[int, int, int]]:
    """(period, start, stop) of match intervals over the whole cell of a tile, and over a whole neighbouring cell.

    ``words`` is the tile, ``cell`` where its cell starts in it, ``size`` the octave.  Positions are the tile's own.
    """
    last = max(periods)
    ahead = z_function(words[cell:], last + 1)
    whole = [q for q in periods if ahead[q] >= size]
    if not whole:
        return []
    powers = set()
    for d in range(1, last // 2 + 1):
        if ahead[d] >= d:
            powers.update(range(2 * d, min(last, ahead[d] + d) + 1, d))
    whole = [q for q in whole if q not in powers]
    if not whole:
        return []
    # matches before the cell: words backwards from its start against words backwards from the start plus q
    before, reach = words[:cell][::-1], words[:cell + last][::-1]
    back = z_function([*before, None, *reach], len(before) + 1 + last)
    out = []
    for q in whole:
        behind = min(back[len(before) + 1 + last - q], cell)
        if ahead[q] >= 2 * size or behind >= size:
            out.append((q, cell - behind, cell + ahead[q]))
    return out


def _grams(code: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """Hashes of 1, 2, 4, ... words from each position on (they run over the end of a document; callers don't look there)."""
    out, m = {1: B.mix(code.astype(np.uint64) + np.uint64(1))}, 1
    while m < longest:
        g = out[m].copy()
        g[:-m] = B.mix(g[:-m] * np.uint64(0x9E3779B97F4A7C15) + g[m:])
        m *= 2
        out[m] = g
    return out


def _asked(start: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, place q words behind it) of every tile of the octave and every period that fits the document."""
    per = n - 2 * size + 1
    first = np.repeat(start + size, per)
    place = np.arange(len(first)) - np.repeat(np.cumsum(per) - per, per)          # from `size` words on
    cell = first - size + place // size * size
    return cell, first + place


def fragments(code: np.ndarray, n: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple]:
    """(row, period, start, stop) of the match fragments of documents of ``n`` words each that lie one behind the other."""
    edge = np.concatenate([[0], np.cumsum(n)])
    grams, out, size = _grams(code, GRAM), [], 1
    while True:
        fits = np.flatnonzero(n >= max(least, times * size))
        if not len(fits):
            return out
        m = min(size, GRAM)
        cell, place = _asked(edge[fits], n[fits], size)
        g = grams[m]
        hit = np.flatnonzero(g[cell] == g[place])
        cell, place = cell[hit], place[hit]
        ends = g[cell + size - m] == g[place + size - m]
        cell, place = cell[ends], place[ends]
        for part in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1) if len(cell) else []:
            c = int(cell[part[0]])
            row = int(np.searchsorted(edge, c, side="right")) - 1
            lo, hi = max(c - size, int(edge[row])), min(c + 4 * size, int(edge[row + 1]))
            base = lo - int(edge[row])
            for q, a, b in solve_tile(code[lo:hi].tolist(), c - lo, size, (place[part] - c).tolist()):
                out.append((row, q, base + a, base + b))
        size *= 2


def _solve(batches, least: int, times: int):
    for run in B.text_runs(batches):
        run = run.combine_chunks()
        texts = run.column(1).chunk(0) if run.num_rows else pa.array([], pa.string())
        flat, n = B.split_words(texts)
        code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        found = sorted(fragments(code, n, least, times))
        per = np.bincount([f[0] for f in found], minlength=len(n)) if found else np.zeros(len(n), np.int64)
        held = pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int32()) for i in (1, 2, 3)],
                                          fields=list(_FRAGMENT))
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat),
                               " ")
        yield pa.RecordBatch.from_arrays([
            run.column(0).chunk(0) if run.num_rows else pa.array([], pa.int64()), pa.array(n), words.cast(pa.string()),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), held)],
            names=["doc_id", "n_words", "words", "fragments"])


def _collapse(batches):
    """Words that a run holds behind its first period go."""
    for batch in batches:
        kept = []
        for words, runs in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            if not runs:
                kept.append(words)
                continue
            words = words.split(" ")
            edge = np.zeros(len(words) + 1, np.int64)
            for r in runs:
                edge[r["start"] + r["period"]] += 1
                edge[r["start"] + r["length"]] -= 1
            kept.append(" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("runs"),
                                          pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "kept_text"])


def stitch(fragments: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(row, runs) of fragments (row, period, start, stop): touching fragments of a document and period are one interval."""
    by = Window.partitionBy("row", "period").orderBy("start", "stop")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") > before).cast("int"), F.lit(1))
    whole = fragments.withColumn("opens", opens).withColumn("island", F.sum("opens").over(by)) \
        .groupBy("row", "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    runs = whole.withColumn("length", length).filter(F.col("length") >= F.greatest(F.lit(least), F.col("period") * times))
    one = F.struct(*[F.col(c).cast("long").alias(c) for c in ("start", "length", "period")])
    return runs.groupBy("row").agg(F.collect_list(one).alias("runs")).select("row", F.array_sort(
        "runs", lambda a, b: by_order((a["start"], b["start"]), (a["period"], b["period"]))).alias("runs"))


def by_order(*pairs) -> Column:
    """-1, 0 or 1: the first pair of unequal values decides."""
    out = F.lit(0)
    for a, b in reversed(pairs):
        out = F.when(a < b, -1).when(a > b, 1).otherwise(out)
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                  times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, kept_text) of every row: its runs by start and period, and its words, joined by one space,
    without the repetitions (a run keeps its first period)."""
    if times < 4:
        raise ValueError("runs of fewer than 4 periods need not cover two whole cells of a tile")
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    folder = f"{checkpoint_root(spark)}/runs-{uuid.uuid4().hex}"
    texts.mapInArrow(lambda it: _solve(it, least, times), SOLVED).withColumn(
        "row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    solved = spark.read.parquet(folder)
    some = solved.filter(F.size("fragments") > 0)
    runs = stitch(some.select("row", F.inline("fragments")), least, times)
    none = F.array().cast(_RUNS)
    repeated = some.select("row", "doc_id", "n_words", "words").join(runs, "row", "left").select(
        "doc_id", "n_words", "words", F.coalesce("runs", none).alias("runs")).mapInArrow(_collapse, SCHEMA)
    plain = solved.filter(F.size("fragments") == 0).select("doc_id", "n_words", none.alias("runs"),
                                                           F.col("words").alias("kept_text"))
    return plain.unionByName(repeated)
