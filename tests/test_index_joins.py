"""Joins by index: text-free resolution (J3, C1), substring search (J4) and the greedy match in rounds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import companies as C
from quillspark.operators import filings as FL
from quillspark.operators.pruning import key_bitmap, prune_to_keys


@pytest.fixture
def no_broadcast(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("bits", [27, 16, 15])
def test_pruning_keeps_every_key_and_few_others(spark, bits):
    rows = spark.range(30_000).select((F.col("id") % 300).cast("string").alias("cik"), F.col("id").alias("acc"),
                                      F.when(F.col("id") % 7 > 0, F.lit("text")).alias("content"))
    keys = rows.filter("acc % 100 = 3").select("cik", "acc")
    left = prune_to_keys(rows, keys, ["cik", "acc"], bits)
    assert left.columns == rows.columns
    assert left.join(keys, ["cik", "acc"], "left_semi").count() == keys.count() == 300
    assert left.count() <= 300 + 30_000 * 300 / 2 ** bits * 2 + 5
    size = key_bitmap(keys, ["cik", "acc"], bits).agg(F.sum(F.octet_length("bits"))).first()[0]
    assert size <= 2 ** bits / 8
    assert prune_to_keys(rows, keys.limit(0), ["cik", "acc"], bits).count() == 0


def _attach_inputs(spark, scratch):
    r = random.Random(4)
    filings = [(f"T{i % 40}", f"{i % 40:010d}", f"acc-{i}", f"20{i % 20:02d}-01-01", i % 5) for i in range(200)]
    landed = [(f"{i % 40:010d}", f"acc-{i}", f"text {i}") for i in range(0, 4000) if i % 3]
    docs = [(f"acc-{i}", p, r.choice(["a-10-k.htm", "ex-1.htm", "b.html"]), "x", f"u{i}-{p}") for i in range(150) for p in (1, 2)]
    for name, rows, schema in (("landed", landed, "cik string, accession string, content string"),
                               ("docs", docs, "accession string, pos int, filename string, doc_type string, url string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{scratch}/{name}")
    chosen = spark.createDataFrame(filings, "ticker string, cik string, accession string, filingDate string, rank int")
    return chosen, filings, landed, docs


def test_text_crosses_one_exchange(no_broadcast, scratch):
    spark = no_broadcast
    chosen, filings, landed, docs = _attach_inputs(spark, scratch)
    out = FL.attach_text(chosen, spark.read.parquet(f"{scratch}/landed"), spark.read.parquet(f"{scratch}/docs"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # an exchange moves the text if the operator below it outputs the column
    lines = plan.split("\n")
    moved = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            depth = re.match(r"^[ :+\-|]*", line).end()
            below = next(x for x in lines[i + 1:] if re.match(r"^[ :+\-|]*", x).end() > depth)
            chunk = lines[i + 1:i + 4]
            moved.append("content#" in below or any("Project" in x and "content#" in x for x in chunk[:1]))
    assert sum(moved) == 1
    assert plan.count("BroadcastExchange") >= 1 and "BroadcastNestedLoopJoin" not in plan
    text = {(c, a): t for c, a, t in landed}
    got = {(r.ticker, r.accession): (r.source, r.content) for r in out.collect()}
    assert len(got) == len(filings)
    assert got == {(t, a): ("submission", text[c, a]) if (c, a) in text else ("index", None) for t, c, a, _, _ in filings}


def test_rows_that_reach_the_text_join_are_the_chosen_ones(spark, scratch):
    chosen, filings, landed, _ = _attach_inputs(spark, scratch)
    left = prune_to_keys(spark.read.parquet(f"{scratch}/landed"), chosen.select("cik", "accession"), ["cik", "accession"])
    wanted = {(c, a) for _, c, a, _, _ in filings} & {(c, a) for c, a, _ in landed}
    assert {(r.cik, r.accession) for r in left.collect()} == wanted


def _titles(r, n):
    parts = ["apple", "Bank", "corp", "é", "Inc", "x", "of", "the", "a", "AA", "zinc", "\U0001d4d0b", ""]
    return [" ".join(r.choice(parts) for _ in range(r.randint(0, 5))) + str(r.randrange(200)) for _ in range(n)]


def _master(spark, titles):
    return spark.createDataFrame([(f"K{i}", t, i) for i, t in enumerate(titles)], "ticker string, title string, first_pos long")


def test_substring_index_equals_contains(spark):
    r = random.Random(2)
    titles = _titles(r, 300) + [None]
    terms = ["", "a", "aa", "app", "apple", "bank of", "é", "é i", "zzz", "1", "12", "123", "\U0001d4d0b", "aaaa", " ", "e ap", "%", "_"]
    t = spark.createDataFrame(list(enumerate(terms)), "term_pos int, term string")
    out = C.match_titles(_master(spark, titles), t)
    got = sorted((x.term_pos, x.ticker) for x in out.collect())
    assert got == sorted((i, f"K{k}") for i, m in enumerate(terms) for k, x in enumerate(titles)
                         if x is not None and m in x.lower())


def test_substring_index_has_no_nested_loop(no_broadcast):
    spark = no_broadcast
    t = spark.createDataFrame([(0, "app")], "term_pos int, term string")
    plan = C.match_titles(_master(spark, ["apple"]), t)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def _greedy(titles, terms):
    used, out = set(), {}
    for i, m in enumerate(terms):
        for k, x in enumerate(titles):
            if k not in used and m.lower() in (x or "").lower():
                used.add(k)
                out[i] = f"K{k}"
                break
    return out


def test_match_rounds_equal_the_serial_pick(spark):
    r = random.Random(7)
    titles = _titles(r, 120)
    terms = [r.choice(["a", "AP", "apple", "12", "3", "corp", "bank", "é", "", "none such", "x", "zinc", "of the"]) for _ in range(40)]
    got = {x.term_pos: x.ticker for x in C.select_companies(_master(spark, titles), terms).collect()}
    assert got == _greedy(titles, terms)


def test_ten_thousand_terms(spark):
    r = random.Random(1)
    titles = [f"company {i:05d} {r.choice('abcdef')}{r.randrange(3000)}" for i in range(12_000)]
    terms = [f"{r.choice('abcdef')}{r.randrange(3000)}" if i % 3 else f"{r.randrange(12_000):05d}" for i in range(10_000)]
    out = C.select_companies(_master(spark, titles), terms)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
    got = {x.term_pos: x.ticker for x in out.collect()}
    assert len(got) > 5000
    by = {}                                       # the serial pick by an index of the two kinds of terms
    for k, x in enumerate(titles):
        _, number, code = x.split(" ")
        by.setdefault(number, []).append(k)
        for cut in range(2, len(code) + 1):
            by.setdefault(code[:cut], []).append(k)
    used, want = set(), {}
    for i, m in enumerate(terms):
        k = next((k for k in by.get(m, ()) if k not in used), None)
        if k is not None:
            used.add(k)
            want[i] = f"K{k}"
    assert got == want
