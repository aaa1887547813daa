"""Periodic runs, centroid clustering, MinHash near-dedup and components against brute force."""

import hashlib
import itertools
import math
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import centroid_cluster as C
from quillspark.llm import minhash_dedup as M
from quillspark.llm import periodic_runs as P
from quillspark.llm import queries as Q
from quillspark.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "doc_id long, text string, words string, runs int, row long, node string, keys map<string,int>, kept int"


# --- periodic runs ---------------------------------------------------------------------------

def brute_runs(words):
    """Every period, every maximal stretch; the smallest period of a stretch stays."""
    seen = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(6, 4 * q):
                seen.setdefault((s, length), q)
            i += 1
    return sorted((s, length, q) for (s, length), q in seen.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def intervals(found):
    by = {}
    for row, q, a, b in sorted(found):
        held = by.setdefault((row, q), [])
        if held and a <= held[-1][1]:
            held[-1][1] = max(held[-1][1], b)
        else:
            held.append([a, b])
    return by


def repetitive(r, letters):
    words = []
    while len(words) < r.randint(0, 150):
        unit = [r.choice(letters) for _ in range(r.randint(1, 18))]
        words += unit * r.randint(1, 8) + unit[:r.randint(0, len(unit))]
    return words


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(1, 6))
def test_tiles_find_every_run(r, letters):
    docs = [repetitive(r, range(letters)) for _ in range(3)]
    found = P.fragments(np.array([w for d in docs for w in d], np.int32), np.array([len(d) for d in docs]))
    runs = [[] for _ in docs]
    for (row, q), held in intervals(found).items():
        runs[row] += [(a, b - a + q, q) for a, b in held if b - a + q >= max(6, 4 * q)]
    assert [sorted(x) for x in runs] == [brute_runs(d) for d in docs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_z_function(s):
    z = P.z_function(s, len(s))
    assert z == [0 if i == 0 else next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def run_rows():
    r = random.Random(5)
    letters = ["a", "A", "ü", "b.", "x"]
    texts = [" ".join(repetitive(r, letters)) for _ in range(60)]
    texts += [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "\ta\n\nb  a b\x0ba b a b ",
              "a " * 30_000, "u v w " * 9_000 + "end", texts[3], texts[3]]
    rows = [(i, t, "w", 1, 2, "n", {"k": 1}, 0) for i, t in enumerate(texts)]
    return [*rows, (4, texts[4], "again", 1, 2, "n", {}, 0), (None, "n o n o n o n o n o", None, None, None, None, None, None)]


def test_runs_of_documents(spark):
    rows = run_rows()
    out = P.periodic_runs(spark.createDataFrame(rows, CLASHING).repartition(3)).collect()
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in out)
    want = []
    for doc_id, text, *_ in rows:
        words = WORD.findall(text or "")
        if len(words) > 5000:              # the two long ones: one run each
            q = 1 if words[1] == "a" else 3
            runs = [(0, 30_000 if q == 1 else 27_000, q)]
        else:
            runs = brute_runs(words)
        want.append((str(doc_id), len(words), runs, collapsed(words, runs)))
    assert got == sorted(want)


def test_runs_empty_table_and_parameters(spark):
    assert P.periodic_runs(spark.createDataFrame([], CLASHING)).collect() == []
    with pytest.raises(ValueError):
        P.periodic_runs(spark.createDataFrame([], CLASHING), times=3)


def test_fragments_meet_over_many_tiles():
    words = np.tile(np.arange(7, dtype=np.int32), 400)
    by = intervals(P.fragments(words, np.array([len(words)])))
    assert by == {(0, 7): [[0, len(words) - 7]]}


def test_op11_digests(spark, tmp_path):
    import zlib
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 90)))) for i in range(300)] + [(7000, None), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[doc_id] = (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None,
                        digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(collapsed(w, runs)))
    out = Q.op11_periodic_runs(spark, str(tmp_path))
    assert {x.doc_id: tuple(x) for x in out.collect()} == want
    assert [t for _, t in out.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sum(v[1] > 0 for v in want.values()) > 10


# --- centroid clustering ---------------------------------------------------------------------

def brute_cluster(rows, k, rounds, size, scale):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cent = [v for _, v in seeds[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cent)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for n in range(len(cent)):
            mine = [v for (_, v), (_, m) in zip(kept, at, strict=True) if m == n]
            if mine:
                cent[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((str(i), n, d, tuple(cent[n])) for (i, _), (d, n) in zip(kept, assign(), strict=True))


VECTORS = "vec_id long, embedding array<double>, v array<long>, lead double, cluster string"


def vector_rows(size, n=400):
    r = np.random.default_rng(4)
    base = r.normal(size=(5, size))
    rows = [(i, (base[i % 5] + r.normal(size=size) * 0.2).tolist(), None, 0.5, "c") for i in range(n)]
    rows += [(i, rows[0][1], [1], None, None) for i in range(n, n + 60)]                  # a hot vector
    rows += [(3, rows[9][1], None, None, None), (3, rows[9][1], None, None, None), (None, rows[1][1], None, None, None)]
    rows += [(9001, None, None, None, None), (9002, [0.5] * (size - 1), None, None, None), (9003, [], None, None, None),
             (9004, [None] + [0.5] * (size - 1), None, None, None), (9005, [float("nan")] * size, None, None, None),
             (9006, [float("inf")] * size, None, None, None), (9007, [0.0] * size, None, None, None)]
    return rows


@pytest.mark.parametrize("size,lead,k", [(64, 12, 16), (6, 2, 7), (6, 6, 3)])
def test_clusters_equal_brute_force(spark, size, lead, k):
    rows = vector_rows(size)
    out = C.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), k=k, size=size, lead=lead).collect()
    want = brute_cluster([r[:2] for r in rows], k, 3, size, 64)
    assert sorted((str(r.vec_id), r.cluster, r.distance, tuple(r.centroid)) for r in out) == want
    total = sum(d for _, _, d, _ in want)
    assert {r.inertia for r in out} == {total}
    for n in range(k):
        assert {r.cluster_inertia for r in out if r.cluster == n} <= {sum(d for _, m, d, _ in want if m == n)}


def test_clusters_of_few_or_no_vectors(spark):
    three = [(i, [float(i)] * 4, None, None, None) for i in range(3)]
    out = C.cluster(spark.createDataFrame(three, VECTORS), k=16, size=4, lead=3).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, tuple(r.centroid)) for r in out) == \
        brute_cluster([r[:2] for r in three], 16, 3, 4, 64)
    empty = C.cluster(spark.createDataFrame([], VECTORS))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    with pytest.raises(ValueError):
        C.cluster(spark.createDataFrame([(1, [1e9] * 4, None, None, None)], VECTORS), size=4, lead=2)


def test_bound_rules_out_most_centroids_and_no_nearest():
    r = np.random.default_rng(1)
    cent = r.integers(-60, 60, (16, 64))
    v = cent[r.integers(0, 16, 2000)] + r.integers(-9, 9, (2000, 64))
    mean = v.mean(axis=0)
    axes = np.linalg.eigh(np.cov(v.T))[1][:, ::-1][:, :12]
    rotation = C.Rotation(mean, axes)
    number, distance, measured = C.nearest(v, *rotation.of(v.astype(float)), cent, rotation)
    every = ((v[:, None, :] - cent[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert measured < 3 * len(v)
    twice = np.concatenate([cent, cent])                  # ties: the smaller number
    assert (C.nearest(v, *rotation.of(v.astype(float)), twice, rotation)[0] == number).all()


# --- MinHash near-dedup ----------------------------------------------------------------------

def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_near(rows, percent=85):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(s), str(low.get(find(i)))) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def near_rows(seed=2):
    """Prose with copies, chains of edits, shared passages, a large group around one base, odd rows."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["The", "THE", "Ünï"]
    prose = lambda k: [r.choice(vocab) for _ in range(k)]
    texts = [prose(r.randint(0, 160)) for _ in range(60)]
    for _ in range(8):                                    # chains: neighbours link, the ends need not
        w = prose(200)
        for _ in range(6):
            w = list(w)
            w[r.randrange(len(w))] = "edit"
            texts.append(w)
    base = prose(150)
    for _ in range(120):                                  # each links to the base, hardly any two to each other
        w = list(base)
        w[r.randrange(5, 70)] = r.choice(vocab)
        w[r.randrange(75, 145)] = r.choice(vocab)
        texts.append(w)
    texts.append(base)
    passage = prose(60)
    texts += [prose(r.randint(5, 60)) + passage + prose(20) for _ in range(80)]
    texts = [" ".join(t) for t in texts]
    texts += texts[:10] * 3 + [None, "", "  ", "one", "ONE", "one two", "one two three four five", " ".join(prose(6000))]
    rows = [(i, t, "w", 1, 2, "n", {"k": 1}, 0) for i, t in enumerate(texts)]
    rows += [(3, texts[3], None, None, None, None, None, None), (None, texts[70], None, None, None, None, None, None),
             (None, " ".join(prose(50)), None, None, None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small):
    if small:                                             # many parts and groups
        for name, value in (("PART", 16), ("GROUP", 100), ("PART_TEXTS", 8), ("GROUP_BYTES", 20_000)):
            monkeypatch.setattr(M, name, value)
    rows = near_rows()
    out = M.near_duplicates(spark.createDataFrame(rows, CLASHING).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute_near(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)


def test_near_duplicates_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], CLASHING)).collect() == []
    only = M.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, only)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_prefixes_of_agreeing_signatures_meet():
    r = np.random.default_rng(3)
    x = r.integers(0, 4, (400, 64)).astype(np.uint32)
    y = x.copy()
    for i in range(400):
        y[i, r.choice(64, 64 - 38, replace=False)] = 9
    long_keys = np.sort(M.pair_keys(x[:1, :40])[0])
    a, b = (M.prefixes(s, long_keys, 27) for s in (x, y))
    assert (a.sum(axis=1) == 27).all() and ((x == y) & a & b).any(axis=1).all()


def test_signatures_estimate_similarity():
    r = np.random.default_rng(6)
    both = r.integers(0, 1 << 63, 4250, dtype=np.uint64)
    own = [r.integers(0, 1 << 63, 375, dtype=np.uint64) for _ in range(2)]
    keys = [np.unique(np.concatenate([both, o])) for o in own]
    s = M.signatures(np.concatenate(keys), np.array([len(k) for k in keys]), 1024)
    assert abs((s[0] == s[1]).mean() - 0.85) < 0.04


# --- components and SQL ----------------------------------------------------------------------

def test_long_path_needs_few_rounds(spark, monkeypatch):
    from quillspark.llm import components as K
    rounds = []
    keep = K.keep
    monkeypatch.setattr(K, "keep", lambda df: rounds.append(1) or keep(df))
    links = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long").repartition(8, F.rand(1))
    got = {r.node: r.label for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(65)} and len(rounds) <= 12


def test_components_equal_brute_force(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(7, 7)]
    parent = list(range(300))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert len(got) == len(nodes) and {g.node: g.label for g in got} == {x: find(x) for x in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sql_of_near_duplicates_and_clusters(spark, tmp_path):
    docs = [(r[0], r[1]) for r in near_rows(9) if r[0] is not None]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(r[0], r[1]) for r in vector_rows(64) if r[0] is not None and (r[1] is None or None not in r[1])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").coalesce(1).write.parquet(
        f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("op12_centroid_cluster", "op13_minhash_dedup"):
        out = Q.QUERIES[name](spark, str(tmp_path))
        rel = con.sql(Q.ORACLE[name])
        assert rel.columns == out.columns
        assert sorted(map(tuple, out.collect()), key=str) == sorted(rel.fetchall(), key=str)
