"""Substring dedup by seed and extend.

Seeds are *winnowed anchors*: of every 10 consecutive 4-word grams (13 words) the
smallest hash is chosen, the rightmost of equals.  The choice depends on those 13 words alone, so
two documents that share 13 consecutive words share an anchor at the same place
in them.  Anchors that occur in two documents are joined (round 1).  Each match is extended both
ways over the anchor to every window of ``length`` words that chose it, and
windows are matched by a 96-bit hash against the smallest doc_id they
start in (round 2).  Overlapping matched windows merge into maximal
repeats, so a repeat of any length is one span.

Both rounds send each distinct key of a block once, so a passage that a third of the
documents share costs one entry per block and no pairs of documents are formed.

Defined cases: a null or empty text has no words; a document shorter than ``length`` words has
no window; a row with null doc_id has no smaller or larger doc_id, so nothing of it is
removed and it removes nothing; repeated rows of one doc_id don't remove each other (and both lose what a
smaller doc_id holds); extra columns are not read.  A 96-bit hash stands for the words of a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillspark.llm import _blocks as B

LENGTH = 13
GRAM = 4
SCHEMA = "doc_id long, n_words long, removed array<struct<start:int,end:int>>, kept_text string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                  ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                  ("kept_text", pa.string())])


def anchors(block: B.Block, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, anchor position of each, gram hashes) of the block; windows stay inside a row."""
    h = block.hashes()[block.tok] if len(block.tok) else np.zeros(0, np.uint64)
    g = B.window_hashes(h, gram)
    w = length - gram + 1
    if len(g) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    view = np.lib.stride_tricks.sliding_window_view(g[::-1], w)[::-1]
    at = np.arange(len(view)) + (w - 1) - view.argmin(axis=1)      # rightmost smallest
    row_end = np.repeat(block.start[1:], block.n)
    ok = np.arange(len(view)) + length <= row_end[:len(view)]
    ok &= ~np.repeat(block.null, block.n)[:len(view)]
    s = np.flatnonzero(ok)
    return s, at[s], g


def _ask_anchors(block, shards, length, gram):
    _, at, g = anchors(block, length, gram)
    at = np.unique(at)
    u, inv = np.unique(g[at], return_inverse=True)
    doc = block.doc[block.row_of()[at]] if len(at) else np.zeros(0, np.int64)
    low, high = np.full(len(u), np.iinfo(np.int64).max), np.full(len(u), np.iinfo(np.int64).min)
    np.minimum.at(low, inv, doc)
    np.maximum.at(high, inv, doc)
    several = low != high
    return B.ask_shared(block, u, several, shards)


def _windows(block, shared, length, gram):
    """Distinct windows over shared anchors: (starts, group of each, f1, f2, smallest doc of each group)."""
    s, at, g = anchors(block, length, gram)
    u = np.unique(g[np.unique(at)])
    s = s[shared[np.searchsorted(u, g[at])]] if len(s) else s
    if not len(s):
        none = np.zeros(0, np.int64)
        return s, none, np.zeros(0, np.uint64), np.zeros(0, np.uint32), none
    f1 = B.window_hashes(block.hashes()[block.tok], length)[s]
    f2 = (B.window_hashes(block.hashes(second=True)[block.tok], length)[s] >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((f2, f1))
    a, b = f1[order], f2[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    group = np.empty(len(s), np.int64)
    group[order] = np.cumsum(new) - 1
    low = np.full(int(new.sum()), np.iinfo(np.int64).max)
    np.minimum.at(low, group, block.doc[block.row_of()[s]])
    return s, group, a[new], b[new], low


def _ask_windows(block, replies, shards, length, gram):
    _, _, f1, f2, low = _windows(block, B.bits(replies), length, gram)
    return B.rows_by_shard(block.number, B.shard_of(f1, shards), lambda a, b: B.pack(f1[a:b], f2[a:b], low[a:b]))


def _answer_windows(datas):
    asked = [B.unpack(d) for d in datas]
    f1, f2, low = (np.concatenate([a[i] for a in asked]) for i in range(3))
    order = np.lexsort((low, f2, f1))
    a, b = f1[order], f2[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    first = low[order][new][np.cumsum(new) - 1]
    smaller = np.empty(len(f1), bool)
    smaller[order] = first < low[order]
    return B.bit_replies(smaller, asked), len(f1), int(new.sum())


def _spans(block, anchor_replies, window_replies, length, gram) -> pa.Table:
    s, group, _, _, low = _windows(block, B.bits(anchor_replies), length, gram)
    smaller = B.bits(window_replies)
    total = int(block.start[-1])
    if len(s):
        s = s[smaller[group] | (block.doc[block.row_of()[s]] > low[group])]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, s, 1)
    np.add.at(edge, s + length, -1)
    gone = np.cumsum(edge)[:total] > 0
    row = block.row_of()
    # maximal runs of removed words inside a row
    prev = np.concatenate([[False], gone[:-1]]) & (np.concatenate([[-1], row[:-1]]) == row) if total else gone
    nxt = np.concatenate([gone[1:], [False]]) & (np.concatenate([row[1:], [-1]]) == row) if total else gone
    begin, end = np.flatnonzero(gone & ~prev), np.flatnonzero(gone & ~nxt) + 1
    runs = np.concatenate([[0], np.cumsum(np.bincount(row[begin], minlength=len(block.n)))]) if total else \
        np.zeros(len(block.n) + 1, np.int64)
    base = block.start[row[begin]] if len(begin) else begin
    spans = pa.ListArray.from_arrays(pa.array(runs.astype(np.int32)), pa.StructArray.from_arrays(
        [pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], names=["start", "end"]))
    stay = ~gone
    left = np.concatenate([[0], np.cumsum(np.bincount(row[stay], minlength=len(block.n)))]) if total else runs
    words = pa.array(block.words, pa.string()).take(pa.array(block.tok[stay]))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words), " ")
    return pa.Table.from_arrays([pa.array(block.doc, mask=block.null), pa.array(block.n), spans, text], schema=_OUT)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                     gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: number of words, maximal repeats removed (word offsets) and the text kept."""
    if not 1 <= gram <= length:
        raise ValueError("1 <= gram <= length is needed")
    blocks = B.token_blocks(docs, id_col, text_col, lower=False)
    shards = B.shard_count(blocks)
    seeds = B.answer(B.ask(blocks, lambda b: _ask_anchors(b, shards, length, gram)), B.answer_shared)
    found = B.answer(B.ask_again(blocks, seeds, lambda b, r: _ask_windows(b, r, shards, length, gram)),
                     _answer_windows)
    return B.tell_both(blocks, seeds, found, lambda b, x, y: _spans(b, x, y, length, gram), SCHEMA)
