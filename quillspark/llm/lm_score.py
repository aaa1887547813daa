"""LM scoring with Elias-Fano n-gram tries.

The model is an interpolated bigram model with absolute discounting (D = 0.75) over the contract's
unigram: ``P(w|v) = max(c(vw) - D, 0) / c(v) + D * kinds(v) / c(v) * P(w)``, with
``P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))`` and ``P(w|v) = P(w)`` for a v that training
never saw; a text starts in a context of its own and closes with an end token.  P(.|v) sums to 1 over the V
training tokens and one unknown.

The trie is sharded by context.  Each shard holds compact levels, written to a scratch file
and memory-mapped: contexts (Elias-Fano), monotone pointers to the first successor of each
(Elias-Fano, their difference is kinds(v)), successors as
``context * W + rank of the word in the shard's list`` (one monotone Elias-Fano sequence, so
a context-relative successor search finds a word among a context's own) and discounted
probabilities as 16-bit codes of their logarithm (step 1/4000 of a decade).  A context with
more than an eighth of a shard's share of the corpus is split over shards by successor;
its kinds add up over them.

All counts come from all training documents; they reach the shards as each block's distinct
words and bigrams.  Shards answer blocks, and the score is summed where the text is.

Defined cases: null and empty texts hold the end token alone; a null doc_id is no held-out row, so it
trains; repeated rows count and are returned once each; an empty table gives no
rows; extra columns are not read.  A 64-bit hash stands for a word.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _blocks as B
from quillspark.llm.elias_fano import EliasFano, MappedArrays, encode

DISCOUNT = 0.75
CODES_PER_DECADE = 4000
FOLDS, HELD_FOLD = 5, 1
START = -1                     # id of the context before the first word
SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                  ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                  ("score", pa.float64())])


def held_out(block: B.Block) -> np.ndarray:
    return np.array([not z and zlib.crc32(str(i).encode()) % FOLDS == HELD_FOLD
                     for i, z in zip(block.doc.tolist(), block.null, strict=True)], bool)


class TrieShard:
    """One shard of the trie over open memory-mapped levels."""

    def __init__(self, levels: dict[str, np.ndarray]):
        part = {}
        for name in ("ctx", "ptr", "succ", "word"):
            part[name] = EliasFano({k.split(".")[1]: a for k, a in levels.items() if k.startswith(name + ".")})
        self.ctx, self.ptr, self.succ, self.word = part["ctx"], part["ptr"], part["succ"], part["word"]
        self.codes = levels["codes"]

    @staticmethod
    def build(ctx: np.ndarray, total: np.ndarray, word: np.ndarray, n: np.ndarray,
              discount: float) -> dict[str, np.ndarray]:
        """Levels from bigrams sorted by (context, word); ``total`` is the context's count on each."""
        new = np.concatenate([[True], ctx[1:] != ctx[:-1]]) if len(ctx) else np.zeros(0, bool)
        words = np.unique(word)
        first = np.flatnonzero(new)
        node = np.cumsum(new) - 1
        succ = node * np.int64(max(len(words), 1)) + np.searchsorted(words, word)
        code = np.rint(-np.log10((n - discount) / np.maximum(total, 1)) * CODES_PER_DECADE)
        levels = {"codes": np.clip(code, 0, 65534).astype(np.uint16)}
        for name, values in (("ctx", ctx[new]), ("ptr", np.concatenate([first, [len(ctx)]])), ("succ", succ),
                             ("word", words)):
            levels |= {f"{name}.{k}": a for k, a in encode(values).items()}
        return levels

    def kinds(self, ctx: np.ndarray) -> np.ndarray:
        """Distinct successors of each context."""
        node, ok = self.ctx.successor(ctx)
        out = np.zeros(len(ctx), np.int64)
        if ok.any():
            out[ok] = (self.ptr.get(node[ok] + 1) - self.ptr.get(node[ok])).astype(np.int64)
        return out

    def lookup(self, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
        """1 + code of each bigram, 0 where the trie has none."""
        node, ok = self.ctx.successor(ctx)
        rank, ok_word = self.word.successor(word)
        ok &= ok_word
        out = np.zeros(len(ctx), np.uint16)
        at, same = self.succ.successor((node[ok] * self.word.n + rank[ok]).astype(np.uint64))
        out[np.flatnonzero(ok)[same]] = self.codes[at[same]] + 1
        return out


def _vocabulary(block: B.Block, train: np.ndarray):
    """(sorted hashes, training count of each, index of each local word and the end token among them)."""
    h = B.word_hashes([*block.words, ""])
    u, at = np.unique(h, return_inverse=True)
    row_train = np.repeat(train, block.n)
    c = np.bincount(at[block.tok[row_train]], minlength=len(u)) if len(block.tok) else np.zeros(len(u), np.int64)
    c[at[-1]] += int(train.sum())
    return u, c, at


def _ask_words(block, shards):
    u, c, _ = _vocabulary(block, ~held_out(block))
    return B.rows_by_shard(block.number, B.shard_of(u, shards), lambda a, b: B.pack(u[a:b], c[a:b]))


def _answer_words(datas):
    asked = [B.unpack(d) for d in datas]
    keys, n = (np.concatenate([a[i] for a in asked]) for i in range(2))
    u, inv = np.unique(keys, return_inverse=True)
    c = np.zeros(len(u), np.int64)
    np.add.at(c, inv, n)
    replies, at = [], 0
    for a in asked:
        own = inv[at:at + len(a[0])]
        replies.append(B.pack(own.astype(np.int64), c[own]))
        at += len(a[0])
    return replies, int(c.sum()), int((c > 0).sum())


class _Bigrams:
    """The distinct bigrams of a block in the order in which they are asked."""

    def __init__(self, block: B.Block, replies, shards: int, share: int):
        self.train = ~held_out(block)
        u, _, at = _vocabulary(block, self.train)
        rank, count = (np.concatenate([B.unpack(r)[i] for r in replies]) for i in range(2))
        ids = rank * shards + B.shard_of(u, shards)
        self.word_id = np.concatenate([ids[at], [START]])      # local words, end, start
        self.count = np.concatenate([count[at], [count[at[-1]]]])
        end, start, size = len(block.words), len(block.words) + 1, len(block.words) + 2
        rows = len(block.n)
        lengths = block.n + 1
        stop = np.cumsum(lengths)
        seq = np.full(int(stop[-1]) if rows else 0, end, np.int64)
        is_end = np.zeros(len(seq), bool)
        is_end[stop - 1] = True
        seq[~is_end] = block.tok
        ctx = np.concatenate([[start], seq[:-1]]) if len(seq) else seq
        ctx[np.concatenate([[0], stop[:-1]]) if rows else []] = start
        self.row, self.seq = np.repeat(np.arange(rows), lengths), seq
        pair, inv = np.unique(ctx * size + seq, return_inverse=True)
        n = np.bincount(inv, weights=self.train[self.row], minlength=len(pair)).astype(np.int64)
        v, w = pair // size, pair % size
        salts = 1 + self.count // max(share, 1)
        sub = (B.mix(self.word_id[w].astype(np.uint64)) % salts[v].astype(np.uint64)).astype(np.int64)
        # every part of a split context is asked, so that its kinds are whole
        used = np.unique(v)
        hot = used[salts[used] > 1]
        extra_v = np.repeat(hot, salts[hot])
        extra_sub = np.concatenate([np.arange(k) for k in salts[hot]]) if len(hot) else np.zeros(0, np.int64)
        v, sub = np.concatenate([v, extra_v]), np.concatenate([sub, extra_sub])
        w, n = np.concatenate([w, np.full(len(extra_v), -1)]), np.concatenate([n, np.zeros(len(extra_v), np.int64)])
        key = B.mix(self.word_id[v].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + sub.astype(np.uint64))
        shard = B.shard_of(key, shards)
        wid = np.where(w >= 0, self.word_id[w], -2)
        order = np.lexsort((wid, self.word_id[v], shard))
        self.v, self.w, self.n, self.shard = v[order], w[order], n[order], shard[order]
        self.wid = wid[order]
        real = order < len(pair)
        self.place = np.empty(len(pair), np.int64)
        self.place[order[real]] = np.flatnonzero(real)         # unique bigram -> its entry
        self.inv = inv

    def part(self, a: int, b: int) -> bytes:
        v = self.v[a:b]
        new = np.concatenate([[True], v[1:] != v[:-1]])
        first = np.flatnonzero(new)
        per = np.diff(np.concatenate([first, [b - a]]))
        return B.pack(self.word_id[v[first]], self.count[v[first]], per.astype(np.int32), self.wid[a:b],
                      self.n[a:b].astype(np.int32))


def _ask_bigrams(block, replies, shards, share):
    g = _Bigrams(block, replies, shards, share)
    return B.rows_by_shard(block.number, g.shard, g.part)


def _answer_bigrams(datas, discount):
    asked = [B.unpack(d) for d in datas]
    ctx = np.concatenate([np.repeat(a[0], a[2]) for a in asked])
    total = np.concatenate([np.repeat(a[1], a[2]) for a in asked])
    word = np.concatenate([a[3] for a in asked])
    n = np.concatenate([a[4] for a in asked]).astype(np.int64)
    order = np.lexsort((word, ctx))
    new = np.concatenate([[True], (ctx[order][1:] != ctx[order][:-1]) | (word[order][1:] != word[order][:-1])])
    group = np.empty(len(ctx), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]
    sums = np.zeros(len(first), np.int64)
    np.add.at(sums, group, n)
    ctx, total, word = ctx[first] + 1, total[first], word[first] + 2       # ids from 0 on
    seen = sums > 0
    replies, at = [], 0
    with MappedArrays(TrieShard.build(ctx[seen], total[seen], word[seen], sums[seen], discount)) as levels:
        trie = TrieShard(levels)
        codes = trie.lookup(ctx.astype(np.uint64), word.astype(np.uint64))
        for a in asked:
            own = group[at:at + len(a[3])]
            replies.append(B.pack(codes[own], trie.kinds((a[0] + 1).astype(np.uint64))))
            at += len(a[3])
    return replies, int(sums.sum()), int(seen.sum())


def _score(block, word_replies, bigram_replies, shards, share, n_all, v_all, discount) -> pa.Table:
    g = _Bigrams(block, word_replies, shards, share)
    parts = [B.unpack(r) for r in bigram_replies]
    code = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint16)])
    kinds_part = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
    # parts of a split context that share a shard are one context there
    new = np.concatenate([[True], (g.v[1:] != g.v[:-1]) | (g.shard[1:] != g.shard[:-1])])
    kinds = np.zeros(len(g.count), np.int64)
    np.add.at(kinds, g.v[new], kinds_part)
    p_word = (g.count + 0.5) / (n_all + 0.5 * (v_all + 1))
    seen = np.where(code > 0, 10.0 ** (-(code.astype(np.float64) - 1) / CODES_PER_DECADE), 0.0)
    total = g.count[g.v]
    p = np.where(total > 0, seen + discount * kinds[g.v] / np.maximum(total, 1) * p_word[g.w], p_word[g.w])
    rows = len(block.n)
    per = np.log10(p[g.place])[g.inv]
    base = np.log10(p_word)[g.seq]
    add = lambda x: np.bincount(g.row, weights=x, minlength=rows)
    return pa.Table.from_arrays([
        pa.array(block.doc, mask=block.null), pa.array(~g.train), pa.array(block.n + 1),
        pa.array(add(g.count[g.seq] > 0).astype(np.int64)), pa.array(np.full(rows, n_all, np.int64)),
        pa.array(add(base)), pa.array(add(per))], schema=_OUT)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    discount: float = DISCOUNT) -> DataFrame:
    """Log10 probability of every text under the bigram trie trained on the rows that are not held out."""
    blocks = B.token_blocks(docs, id_col, text_col, lower=True)
    shards = B.shard_count(blocks)
    words = B.answer(B.ask(blocks, lambda b: _ask_words(b, shards)), _answer_words)
    total = words.agg(F.sum("total"), F.sum("kinds")).first()
    n_all, v_all = int(total[0] or 0), int(total[1] or 0)
    share = max(1, n_all // (8 * shards))
    grams = B.answer(B.ask_again(blocks, words, lambda b, r: _ask_bigrams(b, r, shards, share)),
                     lambda d: _answer_bigrams(d, discount))
    return B.tell_both(blocks, words, grams,
                       lambda b, x, y: _score(b, x, y, shards, share, n_all, v_all, discount), SCHEMA)
