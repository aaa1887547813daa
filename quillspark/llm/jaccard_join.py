"""N-gram Jaccard join with count-vector R-trees.

A document is the set of its distinct 5-word shingles; two link when 100 * intersection >= 75 * union.

Equal sets are one node from the start.  Linked sets share shingles among the first ``p(n) = n - ceil(0.75 n) + 1`` of
each in any common order, and at least ``wanted + min(p(x) - x, p(y) - y)`` of them, where ``wanted`` is the overlap that their
sizes x and y ask for: sets of like size share a tenth of their shingles there.  The order is by the binary logarithm of the
number of nodes that hold a shingle, which a block round counts over all shingles of all nodes: those of one node come first
and are dropped, so a set takes part only if three quarters of it or more occur elsewhere, and a line or passage which
many documents share hardly ever makes candidates.  The round counts ``CODE_BITS`` bits of a shingle within its shard; shingles
that it mixes up are ordered alike everywhere, and none of several nodes is taken for one of a single node.

* Under a shingle of up to ``SMALL`` nodes, pairs are counted: a pair's common prefix shingles, by a join and a sum.
* Under a larger one, shingles are hashed into ``GROUPS`` groups and the group counts are points of an R-tree: the sum of
  coordinate minima bounds the overlap of a point with a whole subtree and then with each point.  Who was found as a partner
  is not asked again, nor who is in the largest of the groups found so far: a group of like sets costs a few searches.

Pairs that stay are verified on the shingles, which are fetched for their nodes alone.

Only components are wanted, so links inside a component are not spelled out.  Nodes under large shingles

1. go, with their shingles, to their most frequent large shingle, in chunks of bounded size, where pairs are verified unless
   both ends are already linked;
2. meet again, some of each component, where a large shingle still sees several components;
3. and then **exactly**: pairs of different components under a large shingle (in pairs of parts) that the R-tree
   bound lets through tie their nodes to clusters, of which a task gives a spanning forest.  A node goes with its shingles to
   its cluster once (and not under each of its large shingles), where all pairs (in pairs of parts) are bounded and verified.

Steps 1 and 2 only save work; no link between different texts is lost, whatever the group sizes.  Pairs never leave the task
that finds them: what it gives out is at most as many rows as it has nodes.

Defined cases: texts without words have no shingles and link with nothing; with fewer than 5 words the whole sequence is the one
shingle; repeated rows are equal sets; a null doc_id links as any row does but is never a component's id unless it is alone
(then null); empty tables give none; extra columns are not read.  A 64-bit hash stands for a shingle, 128
bits for a set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import _blocks as B
from quillspark.llm.components import connected_components

SHINGLE = 5
PERCENT = 75
GROUPS, FULL = 64, 255
SMALL, CHUNK, PART, LEADERS = 64, 8192, 2048, 8
FINE, RUN, MEAN = 1024, 2048, 2048    # finer groups; pairs taken at once; shingles a node of a part has on average at most
STEP = 32                            # rows asked for pairs at once; then those that they settled are left out
CODE_BITS = 26                       # a shard has up to 2 million words: one shingle in 30 meets another's code
ROWS = "block long, row int, doc_id long, n_shingles long, node binary"
LIGHT = "rid long, block long, row int, n long, tokens array<long>, vec binary"
_LIGHT = pa.schema([("rid", pa.int64()), ("block", pa.int64()), ("row", pa.int32()), ("n", pa.int64()),
                    ("tokens", pa.list_(pa.int64())), ("vec", pa.binary())])
BODY = "rid long, n long, vec binary, paired boolean, near boolean, body binary"
_BODY = pa.schema([("rid", pa.int64()), ("n", pa.int64()), ("vec", pa.binary()), ("paired", pa.bool_()), ("near", pa.bool_()),
                   ("body", pa.binary())])
ACTIVE = "token long, rid long, n long, m long"
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Sets:
    """The distinct shingles of a block's rows (of ``rows`` alone): ``key`` sorted within rows, ``start`` offsets."""

    def __init__(self, block: B.Block, k: int, rows: np.ndarray | None = None):
        words, tok = block.n, block.tok
        if rows is not None and len(rows) < len(words):
            mine = np.zeros(len(words), bool)
            mine[rows] = True
            tok, words = tok[np.repeat(mine, words)], np.where(mine, words, 0)
        begin = np.cumsum(words) - words
        h = block.hashes()[tok] if len(tok) else np.zeros(0, np.uint64)
        g = B.window_hashes(h, k)
        inside = np.ones(len(g), bool)
        for j in range(1, k):                             # windows that would reach into the next row
            at = (begin + words)[words >= j] - j
            inside[at[at < len(g)]] = False
        row = np.repeat(np.arange(len(words), dtype=np.int32), words)[:len(g)][inside]
        key = g[inside]
        del g, inside
        cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(words)))]).tolist()
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            key[lo:hi].sort()                             # in place, row by row
        few = np.flatnonzero((words > 0) & (words < k))
        if len(few):                                      # short texts: the whole sequence
            one = np.zeros(len(few), np.uint64)
            for n in range(1, k):
                r = words[few] == n
                if r.any():
                    one[r] = B.mix(B.window_hashes(h, n)[begin[few[r]]] + np.uint64(n))
            at = np.searchsorted(row, few)
            row, key = np.insert(row, at, few), np.insert(key, at, one)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        self.row, self.key = row[new], key[new]
        self.n = np.bincount(self.row, minlength=len(words))
        self.start = np.concatenate([[0], np.cumsum(self.n)])

    def prefix(self, kind: np.ndarray, percent: int) -> np.ndarray:
        """Places of each row's prefix shingles, those of a lower ``kind`` before others."""
        length = self.n - -(-percent * self.n // 100) + 1
        kinds = int(kind.max(initial=0)) + 1
        per = np.bincount(self.row * np.int64(kinds) + kind, minlength=len(self.n) * kinds).reshape(-1, kinds)
        before, used = np.cumsum(per, axis=1) - per, np.zeros(len(kind), bool)
        for c in range(kinds):
            at = np.flatnonzero(kind == c)
            row, first = self.row[at], np.cumsum(per[:, c]) - per[:, c]
            used[at] = before[row, c] + np.arange(len(at)) - first[row] < length[row]
        return np.flatnonzero(used)


def _codes(key: np.ndarray, shards: int) -> np.ndarray:
    """A shingle's shard and ``CODE_BITS`` bits of its place there; in the order of the shingles."""
    at = (key >> np.uint64(32)) * np.uint64(shards)
    return at >> np.uint64(32 - CODE_BITS)


def _distinct(code: np.ndarray) -> np.ndarray:
    """Where a sorted array's values begin."""
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    return new


def _rows(batches, k: int):
    """Every row of a block, with a 128-bit hash of its set."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = B.Block(pa.Table.from_batches([batch.slice(i, 1)]))
            s = Sets(block, k)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in
                    (B.mix(s.key ^ np.uint64(0xA5A5A5A5A5A5A5A5)), B.mix(s.key * np.uint64(3) + np.uint64(1)))]
            node = np.stack([c[s.start[1:]] - c[s.start[:-1]] for c in sums], axis=1)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(s.n), block.number)), pa.array(np.arange(len(s.n), dtype=np.int32)),
                pa.array(block.doc, mask=block.null), pa.array(s.n.astype(np.int64)),
                pa.array([x.tobytes() if n else None for x, n in zip(node, s.n, strict=True)], pa.binary())],
                names=["block", "row", "doc_id", "n_shingles", "node"])


def _ask_codes(blocks: DataFrame, nodes: DataFrame, k: int, shards: int) -> DataFrame:
    """Entries of a round: the codes of all shingles of a block's nodes, with the number of nodes."""
    low = np.uint64((1 << CODE_BITS) - 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return B.entries([])
        block = B.Block(left)
        code = np.sort(_codes(Sets(block, k, right["row"].to_numpy()).key, shards))
        first = np.flatnonzero(_distinct(code))
        n = np.minimum(np.diff(np.append(first, len(code))), 255).astype(np.uint8)
        code = code[first]
        return B.entries(B.rows_by_shard(
            block.number, (code >> np.uint64(CODE_BITS)).astype(np.int64),
            lambda a, b: B.pack(np.diff(code[a:b] & low, prepend=np.uint64(0)).astype(np.uint32), n[a:b])))
    return blocks.groupBy("block").cogroup(nodes.select("block", "row").groupBy("block")).applyInArrow(run, B.ASK_SCHEMA)


def _answer_codes(datas):
    """Reply to :func:`_ask_codes`: the binary logarithm of the number of nodes."""
    asked = [B.unpack(d) for d in datas]
    codes = [np.cumsum(a[0], dtype=np.uint32) for a in asked]
    both = np.concatenate(codes).astype(np.uint64) << np.uint64(8) | np.concatenate([a[1] for a in asked])
    both.sort()
    code, n = both >> np.uint64(8), (both & np.uint64(255)).astype(np.int64)
    first = np.flatnonzero(_distinct(code))
    code, kind = code[first].astype(np.uint32), np.log2(np.add.reduceat(n, first)).astype(np.uint8)
    return [B.pack(kind[np.searchsorted(code, c)]) for c in codes], len(both), len(first)


def _describe(blocks: DataFrame, nodes: DataFrame, kinds: DataFrame, k: int, percent: int, shards: int) -> DataFrame:
    """Nodes with prefix shingles that occur in other nodes (some may not: their codes met others)."""
    own = nodes.select("block", F.lit(-1).alias("shard"), F.lit(None).cast("binary").alias("data"), "row", "rid")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("row", "int"), ("rid", "long"))]
    both = kinds.select("block", "shard", "data", *none).unionByName(own)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pylist([], _LIGHT)
        right = right.sort_by("shard")
        mine = int((right["shard"].to_numpy() < 0).sum())
        block, rows = B.Block(left), right["row"][:mine].to_numpy()
        s = Sets(block, k, rows)
        rid = np.zeros(len(s.n), np.int64)
        rid[rows] = right["rid"][:mine].to_numpy()
        code = _codes(s.key, shards)
        order = np.argsort(code, kind="stable")
        kind = np.zeros(len(code), np.uint8)
        replies = np.concatenate([B.unpack(d.as_py())[0] for d in right["data"][mine:]])
        kind[order] = replies[np.cumsum(_distinct(code[order])) - 1]
        del code, order, replies
        at = s.prefix(kind, percent)
        at = at[kind[at] > 0]
        per = np.bincount(s.row[at], minlength=len(s.n))
        used = np.flatnonzero(per)
        tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per[used])]).astype(np.int32)),
                                          pa.array(s.key[at].view(np.int64)))
        mine = (per > 0)[s.row]
        place = (np.cumsum(per > 0) - 1)[s.row[mine]]
        group = ((s.key[mine] >> np.uint64(7)) % np.uint64(GROUPS)).astype(np.int64)
        vec = np.bincount(place * GROUPS + group, minlength=len(used) * GROUPS)
        vec = np.minimum(vec, FULL).astype(np.uint8).reshape(-1, GROUPS)
        return pa.Table.from_arrays([
            pa.array(rid[used]), pa.array(np.full(len(used), block.number)), pa.array(used.astype(np.int32)),
            pa.array(s.n[used].astype(np.int64)), tokens, pa.array([v.tobytes() for v in vec], pa.binary())], schema=_LIGHT)
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(run, LIGHT)


def _bodies(blocks: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Wanted rows (rid, block, row, ...) with their shingles, which are computed where the block is."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pylist([], _BODY)
        s = Sets(B.Block(left), k, right["row"].to_numpy())
        body = pa.array([B.pack(s.key[s.start[r]:s.start[r + 1]]) for r in right["row"].to_pylist()], pa.binary())
        return right.append_column("body", body).select(_BODY.names)
    return blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, BODY)


# --- R-tree ----------------------------------------------------------------------------------

class CountRTree:
    """R-tree over count vectors, packed by size and main coordinates; nodes keep coordinate maxima and the least size."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        main = np.argsort(-points.var(axis=0))[:3] if len(points) else []
        self.order = np.lexsort([*(points[:, g] for g in main), sizes])
        self.percent = percent
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > self.FAN:
            upper, least = self.levels[-1]
            cut = np.arange(0, len(least), self.FAN)
            self.levels.append((np.maximum.reduceat(upper, cut), np.minimum.reduceat(least, cut)))

    def search(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs whose summed coordinate minima allow the wanted overlap."""
        none = np.zeros(0, np.int64)
        q, p = zip((none, none), *self.runs(points, sizes), strict=True)
        return np.concatenate(q), np.concatenate(p)

    def runs(self, points: np.ndarray, sizes: np.ndarray):
        """The pairs of :meth:`search`, those of 64 queries at a time."""
        for a in range(0, len(sizes), 64):
            q = np.arange(a, min(a + 64, len(sizes)))
            top = len(self.levels[-1][1])
            qi, node = np.repeat(q, top), np.tile(np.arange(top), len(q))
            for level in range(len(self.levels) - 1, -1, -1):
                upper, least = self.levels[level]
                if level < len(self.levels) - 1:
                    child = node[:, None] * self.FAN + np.arange(self.FAN)
                    ok = child < len(least)
                    qi, node = np.repeat(qi, ok.sum(axis=1)), child[ok]
                ok = np.zeros(len(qi), bool)
                for b in range(0, len(qi), 1 << 15):
                    c = slice(b, b + (1 << 15))
                    bound = np.minimum(points[qi[c]], upper[node[c]]).sum(axis=1)
                    # overlap >= p/100 * union, union = |x| + |y| - overlap
                    ok[c] = (100 + self.percent) * bound >= self.percent * (sizes[qi[c]] + least[node[c]])
                qi, node = qi[ok], node[ok]
            yield qi, self.order[node]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="mergesort")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _vectors(table: pa.Table) -> np.ndarray:
    """Count vectors; a full byte stands for any larger count, so it bounds nothing."""
    vec = np.frombuffer(b"".join(v.as_py() for v in table["vec"]), np.uint8).reshape(-1, GROUPS).astype(np.int32)
    vec[vec == FULL] = 1 << 20
    return vec


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the two parts that meet, and whether a part meets itself."""
    side = table["side"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    itself = bool((table["i"].to_numpy() == table["j"].to_numpy()).all())
    return left, left if itself else right, itself


def _meeting(table: pa.Table, percent: int, counted: bool = True):
    """A function of rows that gives their pairs (row, partner) which the R-tree bound and the count of prefix shingles leave, in
    runs; a row's partners are in the other part, or in its own if that meets itself."""
    vec, size = _vectors(table), table["n"].to_numpy()
    many = table["many"].to_numpy() if counted else None
    left, right, itself = _sides(table) if counted else (np.arange(len(size)), np.arange(len(size)), True)
    other = np.zeros(len(size), bool)                           # rows of the right part alone
    if not itself:
        other[right] = True
    spare, trees = -(-percent * size // 100) - 1, {}            # size - prefix length

    def near(rows):
        for back in (False, True):
            mine, theirs = rows[other[rows] == back], left if back else right
            if not len(mine):
                continue
            if back not in trees:
                trees[back] = CountRTree(vec[theirs], size[theirs], percent)
            for q, p in trees[back].runs(vec[mine], size[mine]):
                q, p = mine[q], theirs[p]
                ok = q != p
                if counted:
                    wanted = -(-percent * (size[q] + size[p]) // (100 + percent)) - np.maximum(spare[q], spare[p])
                    ok &= np.minimum(many[q], many[p]) >= wanted
                yield q[ok], p[ok]
    return near


def _active(table: pa.Table, percent: int) -> pa.Table:
    """Nodes that the bounds leave a partner under this token, with their number; who was found as a partner is not asked again."""
    rid, near, meet = table["rid"].to_numpy(), np.zeros(table.num_rows, bool), _meeting(table, percent)
    asked = np.zeros(table.num_rows, bool)
    while len(now := np.flatnonzero(~near & ~asked)[:STEP]):
        asked[now] = True
        for q, p in meet(now):
            near[q] = near[p] = True
    used = np.flatnonzero(near)
    return pa.Table.from_arrays([table["token"].take(pa.array(used)).combine_chunks(), pa.array(rid[used]),
                                 pa.array(table["n"].to_numpy()[used]), pa.array(np.full(len(used), len(used)))],
                                names=["token", "rid", "n", "m"])


def _join_group(table: pa.Table, percent: int) -> pa.Table:
    """Verified links of a group that tie it together; ``label`` tells what is linked already."""
    table = table.sort_by("rid")
    label, bodies = table["label"].to_numpy(), {}
    if not len(label) or (label == label[0]).all():
        return pa.Table.from_pylist([], _LINK)

    def body(i):
        if i not in bodies:
            bodies[i] = B.unpack(table["body"][i].as_py())[0]
        return bodies[i]
    return _pair_rows(table, _forest(label, _meeting(table, percent, counted=False),
                                     link=lambda i, j: linked(body(i), body(j), percent)))


def _forest(group: np.ndarray, meet, bound=None, link=None, cover: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Of the pairs of ``meet`` that pass ``bound`` (arrays) and ``link`` (one pair) as many as tie their groups together.

    A pair of different groups has a row outside the largest group, so rows of the largest one are not asked for pairs; nor
    are others once all rows of ``cover`` were, of which every pair has one.
    """
    _, now = np.unique(group, return_inverse=True)
    turn, asked, out = np.full(len(now), len(now)), 0, []
    while True:
        todo = np.flatnonzero((turn == len(now)) & (now != np.bincount(now).argmax()))
        rest = todo if cover is None else cover[turn[cover] == len(now)]
        todo = (rest if len(rest) < len(todo) else todo)[:STEP]
        if not len(todo):
            return out
        turn[todo] = np.arange(asked, asked + len(todo))
        asked += len(todo)
        for q, p in meet(todo):
            ok = (turn[q] < turn[p]) & (now[q] != now[p])
            q, p = q[ok], p[ok]
            for at in range(0, len(q), RUN):
                x, y = q[at:at + RUN], p[at:at + RUN]
                ok = now[x] != now[y]
                x, y = x[ok], y[ok]
                if bound is not None:
                    ok = bound(x, y)
                    x, y = x[ok], y[ok]
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    if now[i] != now[j] and (link is None or link(i, j)):
                        now[now == now[j]] = now[i]
                        out.append((i, j))


def _open(table: pa.Table, percent: int):
    """:func:`_meeting` for pairs of different components."""
    label, meet = table["label"].to_numpy(), _meeting(table, percent)

    def near(rows):
        for q, p in meet(rows):
            ok = label[q] != label[p]
            yield q[ok], p[ok]
    return near


def _pair_rows(table: pa.Table, pairs: list[tuple[int, int]]) -> pa.Table:
    rid = table["rid"].to_numpy()
    q, p = (rid[np.array([x[k] for x in pairs], np.int64)] for k in (0, 1))
    return pa.Table.from_arrays([pa.array(np.minimum(q, p)), pa.array(np.maximum(q, p))], schema=_LINK)


def _candidates(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of different components to verify, as many as connect the nodes that have any."""
    kinds, label = np.unique(table["label"].to_numpy(), return_inverse=True)
    if len(kinds) < 2:
        return _pair_rows(table, [])
    cover = np.flatnonzero(label != np.bincount(label).argmax())
    return _pair_rows(table, _forest(table["rid"].to_numpy(), _open(table, percent), cover=cover))


def _tie_part(table: pa.Table, percent: int) -> pa.Table:
    """Verified links between components, as many as tie them together; ``label`` tells what is linked already."""
    label = table["label"].to_numpy()
    if (label == label[0]).all():
        return _pair_rows(table, [])
    size, body = table["n"].to_numpy(), [B.unpack(x.as_py())[0] for x in table["body"]]
    count = np.stack([np.bincount(((x >> np.uint64(17)) % np.uint64(FINE)).astype(np.int64), minlength=FINE).astype(np.int32)
                      for x in body])

    def bound(x, y):
        return (100 + percent) * np.minimum(count[x], count[y]).sum(axis=1) >= percent * (size[x] + size[y])
    return _pair_rows(table, _forest(label, _meeting(table, percent), bound, lambda i, j: linked(body[i], body[j], percent)))


def _verify(batches, percent: int):
    for batch in batches:
        t = pa.Table.from_batches([batch])
        ok = [linked(B.unpack(x.as_py())[0], B.unpack(y.as_py())[0], percent) for x, y in zip(t["x"], t["y"], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))],
                                         names=["a", "b"])


def component_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                  percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, node, component_id) of every row of ``docs``; node tells equal sets."""
    spark = docs.sparkSession
    blocks = B.token_blocks(docs, id_col, text_col, lower=True, placed=True)
    B.release(spark)
    shards = B.shard_count(blocks)
    rows = B.keep(blocks.mapInArrow(lambda it: _rows(it, shingle), ROWS).withColumn("rid", F.monotonically_increasing_id()))
    nodes = B.keep(rows.filter("n_shingles > 0").groupBy("node").agg(
        F.min(F.struct("rid", "block", "row")).alias("r"), F.min("doc_id").alias("low")).select("node", "r.*", "low"))
    kinds = B.answer(_ask_codes(blocks, nodes, shingle, shards), _answer_codes)
    light = B.keep(_describe(blocks, nodes, kinds, shingle, percent, shards))
    del kinds
    B.release(spark)
    labels = connected_components(_links(blocks, light, percent, shingle)).withColumnRenamed("node", "rid")
    member = nodes.join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    lowest = member.groupBy("label").agg(F.min("low").alias("component_id"))
    member = member.join(lowest, "label").select("node", "component_id")
    return rows.select("doc_id", "n_shingles", "node").join(member, "node", "left").select(
        "doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"))


def _wanted(a: str, b: str, percent: int):
    """Prefix shingles that linked sets of these sizes share at least."""
    spare = [F.ceil(F.col(n) * percent / 100) - 1 for n in (a, b)]          # size - prefix length
    return F.ceil((F.col(a) + F.col(b)) * percent / (100 + percent)) - F.greatest(*spare)


def _links(blocks: DataFrame, light: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Verified links (a, b) between nodes that give their components."""
    spark = light.sparkSession
    tokens = light.select("rid", "n", F.explode("tokens").alias("token"))
    tokens = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1"), "token")
    tokens = B.keep(tokens)
    B.release(spark)
    many = B.keep(tokens.filter(F.col("m") > SMALL).groupBy("rid").agg(F.count("*").cast("int").alias("many")))
    pairs = B.keep(_small_pairs(tokens.filter(F.col("m") <= SMALL).join(many, "rid", "left"), percent))
    B.release(spark)
    vectors = B.keep(light.select("rid", "vec").join(many, "rid"))
    # of a shingle of several parts all nodes stay: to hold each part against all others only to leave out some costs more
    near = _parts(tokens.filter(F.col("m").between(SMALL + 1, PART)), vectors).groupBy("token").applyInArrow(
        lambda t: _active(t, percent), ACTIVE).union(tokens.filter(F.col("m") > PART).select("token", "rid", "n", "m"))
    near = B.keep(near)
    del tokens, many
    B.release(spark)
    ends = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).select("rid", F.lit(False).alias("large"))
    used = ends.union(near.select("rid", F.lit(True))).groupBy("rid").agg(
        F.bool_or(~F.col("large")).alias("paired"), F.bool_or("large").alias("near"))
    wanted = B.keep(light.drop("tokens").join(used, "rid"))
    bodies = B.keep(_bodies(blocks, wanted, shingle))
    del light, ends, used, wanted
    links = _verified(pairs, bodies.filter("paired"), percent)
    bodies = bodies.filter("near")             # steps that need few sets do not send them all
    del pairs
    B.release(spark)
    widest = near.agg(F.max("m")).first()[0]
    if not widest:
        return links
    chunk = F.pmod(F.xxhash64("rid"), F.ceil(F.col("m") / CHUNK))
    first = _tie(_open_tokens(near, connected_components(links)).withColumn("chunk", chunk), bodies, percent)
    links = links.unionByName(first)
    B.release(spark)
    rest = _open_tokens(near, connected_components(links))
    if widest > CHUNK:                     # else every large shingle was one chunk
        pick = Window.partitionBy("token", "label").orderBy(F.xxhash64("rid", "token"), "rid")
        few = rest.withColumn("k", F.row_number().over(pick)).filter(F.col("k") <= LEADERS)
        links = links.unionByName(_tie(few.withColumn("chunk", F.lit(0).cast("long")).drop("k"), bodies, percent, bound=True))
        rest = _open_tokens(near, connected_components(links))
    B.release(spark)
    hints = _parts(rest, vectors).groupBy("token", "i", "j").applyInArrow(
        lambda t: _candidates(t, percent), "a long, b long")
    units = _units(rest, connected_components(hints).withColumnRenamed("label", "cluster"))
    B.release(spark)
    last = _parts(units, vectors.join(bodies.select("rid", "body"), "rid")).groupBy(
        "cluster", "token", "i", "j").applyInArrow(lambda t: _tie_part(t, percent), "a long, b long")
    return links.unionByName(B.keep(last))


def _small_pairs(small: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes that share as many prefix shingles as linked sets of their sizes must.

    Common small shingles are counted; of large ones no more can be common than either node has.
    """
    side = small.select("token", "rid", "n", F.coalesce("many", F.lit(0)).alias("many"))
    x, y = (side.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("rid", "n", "many")]) for k in "ab")
    ratio = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    lacking = (_wanted("n_a", "n_b", percent) - F.least("many_a", "many_b")).cast("int")
    pairs = x.join(y, "token").filter(F.col("rid_a") < F.col("rid_b")).filter(ratio).select(
        F.col("rid_a").alias("a"), F.col("rid_b").alias("b"), lacking.alias("lacking"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("common"), F.max("lacking").alias("lacking")) \
        .filter("common >= lacking").select("a", "b")


def _verified(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    one = bodies.select(F.col("rid").alias("a"), F.col("body").alias("x"))
    two = bodies.select(F.col("rid").alias("b"), F.col("body").alias("y"))
    return B.keep(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(
        lambda it: _verify(it, percent), "a long, b long"))


def _tie(rows: DataFrame, bodies: DataFrame, percent: int, bound: bool = False) -> DataFrame:
    """Links found where each node goes once: to its most frequent token, in chunks."""
    best = rows.select("rid", "m", "token", "chunk", "label").groupBy("rid").agg(
        F.max(F.struct("m", "token", "chunk", "label")).alias("t")).select("rid", "t.*")
    if bound:
        many = best.groupBy("token").agg(F.count("*").alias("in_token"))
        best = best.join(many, "token").withColumn(
            "chunk", F.pmod(F.xxhash64("rid"), F.ceil(F.col("in_token") / CHUNK))).drop("in_token")
    full = best.join(bodies, "rid").select("token", "chunk", "rid", "label", "n", "vec", "body")
    return B.keep(full.groupBy("token", "chunk").applyInArrow(
        lambda t: _join_group(t.drop_columns(["token", "chunk"]), percent), "a long, b long"))


def _open_tokens(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (token, rid, m, label) of tokens that see more than one component."""
    full = tokens.join(labels.withColumnRenamed("node", "rid"), "rid", "left").withColumn(
        "label", F.coalesce("label", "rid"))
    several = full.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1")) \
        .filter("l0 <> l1").select("token")
    return B.keep(full.join(several, "token", "left_semi").select("token", "rid", "n", "m", "label"))


def _units(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows (cluster, token, rid, n, label, m) of the units in which pairs are verified: clusters (token is null).

    A cluster that long chains made may hold more pairs than its tokens together; then these are its units.
    """
    full = B.keep(rows.drop("m").join(clusters.withColumnRenamed("node", "rid"), "rid"))
    weight = F.greatest(F.count("*"), F.ceil(F.sum("n") / MEAN)).alias("m")
    nodes = full.select("cluster", "rid", "n", "label").distinct()
    by_token = full.groupBy("cluster", "token").agg(F.count("*").alias("k"), weight).filter("k > 1")
    by_cluster = nodes.groupBy("cluster").agg(F.count("*").alias("k"), weight).join(
        by_token.groupBy("cluster").agg(F.sum(F.col("k") * F.col("k")).alias("pairs")), "cluster")
    whole = by_cluster.filter("k * k <= pairs").select("cluster", "m")
    cut = by_cluster.filter("k * k > pairs").select("cluster")
    columns = ["cluster", "token", "rid", "n", "label", "m"]
    return B.keep(nodes.join(whole, "cluster").withColumn("token", F.lit(None).cast("long")).select(columns).unionByName(
        full.join(by_token.join(cut, "cluster", "left_semi").drop("k"), ["cluster", "token"]).select(columns)))


def _parts(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows of each token with their vectors, large tokens cut into parts of which every two meet once.

    Part p is side 0 of (p, j) for j >= p and side 1 of (i, p) for i < p; m is the number of nodes under the token.
    """
    cut = rows.withColumn("parts", F.ceil(F.col("m") / PART).cast("int")).withColumn(
        "part", F.pmod(F.xxhash64("rid"), "parts").cast("int")).drop("m")
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(
        F.least("part", o).alias("i"), F.greatest("part", o).alias("j"), (o < F.col("part")).cast("int").alias("side")))
    return cut.join(vectors, "rid").select("*", F.explode(meet).alias("at")).select("*", "at.*").drop(
        "at", "parts", "part")
