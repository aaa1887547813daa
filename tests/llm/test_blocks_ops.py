"""Block rounds, LM scoring, substring dedup, Jaccard join and components against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import _blocks as B
from quillspark.llm import jaccard_join
from quillspark.llm.components import connected_components
from quillspark.llm.elias_fano import EliasFano, MappedArrays, encode
from quillspark.llm.jaccard_join import CountRTree, component_ids
from quillspark.llm.lm_score import score_documents
from quillspark.llm.substring_dedup import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, data string, block long"     # clashing names of extra columns


def corpus(seed=3, n=120):
    """Random prose with copies, near copies, shared passages, nulls, empties, short and long texts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["The", "THE", "the", "Ünï", "a b"]
    prose = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = prose(30)
    texts = [prose(r.randint(0, 80)) for _ in range(n)]
    for i in range(0, n, 7):
        texts.append(texts[i])
    for i in range(0, n, 5):
        w = texts[i].split(" ")
        if len(w) > 20:
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [f"{prose(9)}\n{passage}\t{prose(5)}" for _ in range(12)]
    texts += [None, "", "   ", "one", "one two three", "one  two\nthree", prose(4000), passage, passage]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "again", 2), (None, passage, "no id", 3)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    if lower and text:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text or "")


@given(st.lists(st.integers(0, 2**40), max_size=400), st.lists(st.integers(0, 2**40), max_size=50))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, asked):
    values = sorted(values)
    with MappedArrays(encode(np.array(values, np.uint64))) as arrays:
        ef = EliasFano(arrays)
        if values:
            assert ef.get(np.arange(len(values))).tolist() == values
        asked = asked + values[:20]
        at, same = ef.successor(np.array(asked, np.uint64))
        for x, i, s in zip(asked, at.tolist(), same.tolist(), strict=True):
            assert s == (x in values)
            assert i == sum(v < x for v in values)


@given(st.lists(st.lists(st.integers(-2**60, 2**60)), max_size=4))
@settings(max_examples=40, deadline=None)
def test_pack_round_trip(arrays):
    arrays = [np.array(a, np.int64) for a in arrays] + [np.array([1, 2], np.uint8)]
    assert [a.tolist() for a in B.unpack(B.pack(*arrays))] == [a.tolist() for a in arrays]


def brute_lm(rows):
    seqs = [(i, words(t, True) + [""]) for i, t, *_ in rows]
    c, pairs = collections.Counter(), collections.Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, w in seqs:
        if not held(i):
            c.update(w)
            pairs.update(zip([None, *w[:-1]], w, strict=True))
    n, v = sum(c.values()), len(c)
    total, kinds = collections.Counter(), collections.Counter()
    for (a, _), k in pairs.items():
        total[a] += k
        kinds[a] += 1
    out = []
    for i, w in seqs:
        p = [(c[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        q = [max(pairs[a, x] - 0.75, 0) / total[a] + 0.75 * kinds[a] / total[a] * y if total[a] else y
             for a, x, y in zip([None, *w[:-1]], w, p, strict=True)]
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(map(math.log10, p)), sum(map(math.log10, q))))
    return out


def by_row(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) if not isinstance(x, float) else (False, round(x, 4))
                                            for x in r))


def test_lm_score(spark, docs):
    got = by_row(tuple(r) for r in score_documents(docs).collect())
    want = by_row(brute_lm(corpus()))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], abs=2e-4 * w[2])     # 16-bit codes of probabilities


def test_lm_score_gains_on_held_out_text(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog " * 3, None, 0) for i in range(60)]
    out = score_documents(spark.createDataFrame(rows, SCHEMA)).filter("held_out").collect()
    assert out and all(r.score > r.base_score for r in out)


def test_lm_probabilities_sum_to_one(spark):
    """Over the vocabulary and one unknown, given a seen context."""
    train_ids = [i for i in range(9) if zlib.crc32(str(i).encode()) % 5 != 1][:2]
    train = [(train_ids[0], "a b a c", None, 0), (train_ids[1], "a b b", None, 0)]
    held = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 5 == 1)
    probe = [(held, f"a {w}", None, 0) for w in ("a", "b", "c", "unknown")] + [(held, "a", None, 0)]
    rows = brute_lm(train + probe)
    one = {w: r for w, r in zip(["a", "b", "c", "unknown", ""], rows[2:], strict=True)}
    got = score_documents(spark.createDataFrame(train + probe, SCHEMA)).filter("held_out").collect()
    assert sorted(round(r.score, 3) for r in got) == sorted(round(r[6], 3) for r in one.values())


def brute_substrings(rows, length=13):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        if i is not None:
            for p in range(len(w) - length + 1):
                k = tuple(w[p:p + length])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t, *_ in rows:
        w, gone = words(t), set()
        if i is not None:
            for p in range(len(w) - length + 1):
                if first[tuple(w[p:p + length])] < i:
                    gone.update(range(p, p + length))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substring_dedup(spark, docs):
    got = dedup_substrings(docs).collect()
    rows = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), r.kept_text) for r in got]
    assert by_row(rows) == by_row(brute_substrings(corpus()))
    for r in got:                                    # maximal: no two spans touch
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))


@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(6, 9))
@settings(max_examples=5, deadline=None)
def test_substring_dedup_other_lengths(spark, seed, gram, length):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 40))), None, 0) for i in range(25)]
    got = dedup_substrings(spark.createDataFrame(rows, SCHEMA), length=length, gram=gram).collect()
    assert by_row((x.doc_id, x.n_words, sum(s.end - s.start for s in x.removed), x.kept_text) for x in got) \
        == by_row(brute_substrings(rows, length))


def shingles(text):
    w = words(text, True)
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    low = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)].append(i)
    return [(i, len(s), min(low[find(k)], default=None)) for k, (i, s) in enumerate(sets)]


def test_jaccard_join(spark, docs):
    got = component_ids(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert by_row(tuple(r) for r in got) == by_row(brute_components(corpus()))


def test_jaccard_join_of_a_drifting_group(spark):
    """A large group whose members link with some of the others only: chains must not be cut."""
    r = random.Random(5)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w), None, 0))
    rows += [(1000 + i, " ".join(base[:30] + [f"y{i}{k}" for k in range(40)]), None, 0) for i in range(20)]
    got = component_ids(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()
    assert by_row(tuple(r) for r in got) == by_row(brute_components(rows))


def test_jaccard_join_of_groups_of_several_parts(spark, monkeypatch):
    """Shingles of more nodes than a part or a chunk holds."""
    for name, value in (("SMALL", 4), ("PART", 16), ("CHUNK", 32), ("LEADERS", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    r = random.Random(9)
    base = [[f"{g}t{i}" for i in range(40)] for g in range(3)]
    rows = []
    for i in range(170):
        w = list(base[r.choice([0, 0, 0, 1, 2])])
        for _ in range(r.randint(0, 3)):
            w[r.randrange(40)] = f"x{r.randrange(6)}"
        rows.append((i if i % 9 else None, " ".join(w), None, 0))
    got = component_ids(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()
    assert by_row(tuple(x) for x in got) == by_row(brute_components(rows))


def test_jaccard_join_moves_only_sets_that_can_link(spark, monkeypatch):
    """Sets with more than a quarter of shingles of their own make no candidates, whatever passage they share; blocks stay where
    they are."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"x{i}w{k}" for k in range(30)), None, 0) for i in range(90)]
    rows += [(1000 + i, " ".join(f"y{i // 2}w{k}" for k in range(60)) + f" z{i}", None, 0) for i in range(8)]
    rows += [(2000 + i, rows[i][1], None, 0) for i in range(90)]
    moved, bodies = [], jaccard_join._bodies

    def spy(blocks, wanted, k):
        out = bodies(blocks, wanted, k)
        moved.append((wanted.count(), out._jdf.queryExecution().sparkPlan().toString(), blocks, wanted))
        return out
    monkeypatch.setattr(jaccard_join, "_bodies", spy)
    got = component_ids(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()
    assert by_row(tuple(r) for r in got) == by_row(brute_components(rows))
    (n, _, blocks, wanted), = moved
    assert n == 8
    plan = blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(
        lambda x, y: x.select(["block"]), "block long")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_jaccard_join_counts_nodes_not_rows(spark):
    """Shingles of one node are told from those of several, across blocks and within one, whatever their codes."""
    r = random.Random(8)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randint(1, 60))) for _ in range(60)]
    rows = [(i, texts[r.randrange(60)], None, 0) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    blocks = B.keep(B.token_blocks(docs, "doc_id", "text", lower=True, block_bytes=700))
    shards = 3
    every = blocks.mapInArrow(lambda it: jaccard_join._rows(it, 5), jaccard_join.ROWS).withColumn(
        "rid", F.monotonically_increasing_id()).filter("n_shingles > 0").cache()
    nodes = every.groupBy("node").agg(F.min(F.struct("rid", "block", "row")).alias("r")).select("node", "r.*").cache()
    asked = jaccard_join._ask_codes(blocks, nodes, 5, shards)
    kinds = B.answer(asked, jaccard_join._answer_codes)
    light = jaccard_join._describe(blocks, nodes, kinds, 5, 75, shards).collect()
    sets = {frozenset(shingles(t)) for _, t, *_ in rows}
    held = collections.Counter(x for s in sets for x in s)
    free = [s for s in sets if 4 * sum(held[x] == 1 for x in s) <= len(s)]               # these and no others take part
    assert nodes.count() == len(sets) < 300
    assert sorted(x.n for x in light) == sorted(len(s) for s in free) and 5 < len(free) < len(sets) - 5


def near_rows(n, seed=3):
    """Rows of one group, as tasks get them: sets of up to 40 shingles, most of a common 50; each a component of its own."""
    r = random.Random(seed)
    sets = [sorted({r.randrange(50) * 2654435761 for _ in range(80)} | {2**40 + 4096 * k + x for x in range(r.randint(0, 12))})[:40]
            for k in range(n)]
    keys = [B.mix(np.array(x, np.uint64)) for x in sets]
    vec = [np.bincount(((x >> np.uint64(7)) % np.uint64(64)).astype(int), minlength=64).astype(np.uint8).tobytes() for x in keys]
    return sets, pa.table({"rid": pa.array(range(n), pa.int64()), "n": pa.array([len(x) for x in sets], pa.int64()),
                           "label": pa.array(range(n), pa.int64()), "many": pa.array([40] * n, pa.int32()),
                           "vec": pa.array(vec, pa.binary()), "body": pa.array([B.pack(np.sort(x)) for x in keys], pa.binary()),
                           "side": pa.array([0] * n, pa.int32()), "i": pa.array([0] * n, pa.int32()),
                           "j": pa.array([0] * n, pa.int32())})


def roots(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = label[a], label[b]
        label = [min(x, y) if z in (x, y) else z for z in label]
    return label


def test_pairs_stay_in_the_task_that_finds_them():
    """A group gives out fewer rows than it has nodes, and these tie together what all its links do."""
    sets, table = near_rows(200)
    links = [(a, b) for a in range(200) for b in range(a) if 175 * len({*sets[a]} & {*sets[b]}) >= 75 * (len(sets[a]) + len(sets[b]))]
    assert len(links) > 200
    for got in (jaccard_join._candidates(table, 75), jaccard_join._tie_part(table, 75)):
        assert 0 < got.num_rows < 200
        pairs = list(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
        label = roots(200, pairs)
        assert all(label[a] == label[b] for a, b in links)
    assert label == roots(200, links)


def test_a_group_of_like_sets_costs_a_few_searches(monkeypatch):
    """What is settled is not searched for again, and rows outside of the group are still found."""
    sets, table = near_rows(600, seed=5)
    table = table.append_column("token", pa.array([1] * 600, pa.int64()))
    alone = [B.mix(np.arange(2**50 + 99 * k, 2**50 + 99 * k + 40, dtype=np.uint64)) for k in range(5)]
    vec = [np.bincount(((x >> np.uint64(7)) % np.uint64(64)).astype(int), minlength=64).astype(np.uint8).tobytes() for x in alone]
    odd = table.slice(0, 5).set_column(0, "rid", pa.array(range(600, 605), pa.int64())) \
        .set_column(2, "label", pa.array(range(600, 605), pa.int64())).set_column(4, "vec", pa.array(vec, pa.binary())) \
        .set_column(1, "n", pa.array([40] * 5, pa.int64())).set_column(5, "body", pa.array([B.pack(np.sort(x)) for x in alone]))
    table, asked, runs = pa.concat_tables([table, odd]), [], CountRTree.runs
    links = [(a, b) for a in range(600) for b in range(a) if 175 * len({*sets[a]} & {*sets[b]}) >= 75 * (len(sets[a]) + len(sets[b]))]
    want = roots(605, links)
    monkeypatch.setattr(CountRTree, "runs", lambda self, points, sizes: (asked.append(len(sizes)), runs(self, points, sizes))[1])
    near = {*jaccard_join._active(table, 75)["rid"].to_pylist()}
    assert sum(asked) < 300 and near.isdisjoint(range(600, 605)) and near >= {x for pair in links for x in pair}
    for find in (jaccard_join._candidates, jaccard_join._tie_part, jaccard_join._join_group):
        asked.clear()
        got = find(table, 75)
        label = roots(605, zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
        assert all(label[a] == label[b] for a, b in links) and got.num_rows < 605
        assert find is jaccard_join._candidates or label == want
        assert sum(asked) < 300
    one = table.set_column(2, "label", pa.array([0] * 604 + [9], pa.int64()))                # the last one alone is not linked yet
    asked.clear()
    assert jaccard_join._candidates(one, 75).num_rows == jaccard_join._tie_part(one, 75).num_rows == 0 and sum(asked) <= 2


def test_units_are_clusters_or_their_tokens(spark):
    """A node goes to its cluster once; a cluster of few common tokens is taken token by token."""
    tight = [(t, r, 50, 9, r) for t in range(5) for r in range(10)]
    chain = [(100 + t, 1000 + r, 50, 9, r) for t in range(20) for r in (t, t + 1)] + [(7, 1000, 50, 9, 0)]
    rows = spark.createDataFrame(tight + chain, "token long, rid long, n long, m long, label long")
    clusters = spark.createDataFrame([(r, 0) for r in range(10)] + [(1000 + r, 1000) for r in range(21)], "node long, cluster long")
    got = collections.defaultdict(set)
    for x in jaccard_join._units(rows, clusters).collect():
        got[x.cluster, x.token].add((x.rid, x.n, x.m))
    assert got == {(0, None): {(r, 50, 10) for r in range(10)},
                   **{(1000, 100 + t): {(1000 + t, 50, 2), (1001 + t, 50, 2)} for t in range(20)}}


@given(st.integers(0, 10**6))
@settings(max_examples=25, deadline=None)
def test_rtree_keeps_every_close_pair(seed):
    r = np.random.default_rng(seed)
    points = r.integers(0, 5, (90, 8)).astype(np.int32)
    sizes = points.sum(axis=1).astype(np.int64)
    q, p = CountRTree(points, sizes, 75).search(points, sizes)
    got = set(zip(q.tolist(), p.tolist(), strict=True))
    want = {(a, b) for a in range(90) for b in range(90)
            if 175 * np.minimum(points[a], points[b]).sum() >= 75 * (sizes[a] + sizes[b])}
    assert got == want


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 50)] + \
        [(r.randrange(200, 240), r.randrange(200, 240)) for _ in range(25)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_empty_tables(spark, empty):
    assert score_documents(empty).count() == 0
    assert dedup_substrings(empty).count() == 0
    assert component_ids(empty).count() == 0


def test_blocks_hold_all_rows_whatever_their_size(spark, docs):
    blocks = B.token_blocks(docs, "doc_id", "text", lower=False, block_bytes=500)
    assert blocks.count() > 5
    assert blocks.select(F.explode("doc")).count() == len(corpus())
    n = blocks.select(F.explode("n").alias("n")).agg(F.sum("n")).first()[0]
    assert n == sum(len(words(t)) for _, t, *_ in corpus())


def test_query_digests(spark):
    from quillspark.llm.queries import QUERIES
    rows = {r.doc_id: r for r in QUERIES["op9_substring_dedup"](spark, "/root/testdata/sf0.001").collect()}
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for i, n, gone, kept in brute_substrings(texts):
        assert (rows[i].n_words, rows[i].n_removed) == (n, gone)
        assert rows[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
