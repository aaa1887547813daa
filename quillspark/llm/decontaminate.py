"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations alone.

An item's words form windows of ``window`` consecutive words (a shorter item is one window).  All words of a
window must be in a document that holds it, so a window's necessary prefix is one word: its
rarest, by counts over all documents.  Documents keep the positions of prefix words with their
surroundings (positional bound: no window reaches farther), these meet the windows in an equi-join on the prefix word, the
length bound drops windows that do not fit the document, and word-by-word comparison verifies the
rest, each over its own item's window size.

Texts are split into words twice (rarity, prefix positions) and never shuffled.  Prefix words enter the
scan as a literal set, in runs of at most ``words_per_pass``, so the plan stays bounded for a benchmark of any size.

Defined cases: null text has no words; empty items have no window; an item with null id marks words as hit but
cannot be counted or listed; repeated items count once; repeated or null doc_ids give one result row each;
empty tables give no row or no hit; extra columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._blocks import keep

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
WORDS_PER_PASS = 20_000


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else (``lower`` does just that to a text of single bytes)."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    # null text: an empty array
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), 0)


def _in_set(name: str, words: list[str]) -> str:
    """SQL test of ``name`` against words (which hold no quote or backslash)."""
    return f"{name} IN ({', '.join(repr_sql(w) for w in words)})"


def repr_sql(word: str) -> str:
    return "'" + word + "'"


def _passes(words: DataFrame, per_pass: int) -> list[list[str]]:
    """Distinct words of the benchmark side in runs of at most ``per_pass``."""
    rows = keep(words.select("word").distinct())
    n = rows.count()
    runs = -(-n // per_pass)
    part = F.pmod(F.xxhash64("word"), F.lit(2 * runs)) if runs > 1 else F.lit(0)
    rows = rows.withColumn("run", part)
    return [sorted(r.word for r in rows.filter(F.col("run") == i).select("word").collect())
            for i in range(2 * runs if runs > 1 else runs)]


def item_windows(items: DataFrame, docs: DataFrame, item_col: str, item_text: str, text_col: str, window: int,
                 per_pass: int) -> DataFrame:
    """(item_id, key, words, prefix, offset): distinct windows per item with their rarest word."""
    item = keep(items.select(F.col(item_col).cast("long").alias("item_id"), words_of(F.col(item_text)).alias("w"))
                .filter(F.size("w") > 0).withColumn("item", F.monotonically_increasing_id()))
    word = item.select("item", "item_id", F.posexplode("w").alias("pos", "word"))
    counts = None
    for run in _passes(word, per_pass):
        if not run:
            continue
        held = docs.select(words_of(F.col(text_col)).alias("w")).select(
            F.explode(F.expr(f"filter(w, x -> {_in_set('x', run)})")).alias("word"))
        n = held.groupBy("word").agg(F.count("*").alias("n"))
        counts = n if counts is None else counts.unionByName(n)
    if counts is None:
        counts = word.select("word", F.lit(0).cast("long").alias("n")).limit(0)
    spread = word.join(counts, "word", "left").groupBy("item", "item_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "word", F.coalesce("n", F.lit(0)).alias("n")))).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    each = spread.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("v"))
    rarest = F.array_min(F.transform("v", lambda x, j: F.struct(x["n"].alias("n"), x["word"].alias("word"),
                                                                j.alias("offset"))))
    return keep(each.select("item_id", F.transform("v", lambda x: x["word"]).alias("words"), rarest.alias("r"))
                .select("item_id", F.array_join("words", " ").alias("key"), "words", F.col("r.word").alias("prefix"),
                        F.col("r.offset").alias("offset")).distinct())


def _near(docs: DataFrame, text_col: str, prefix: list[str], window: int) -> Column:
    """Positions (from 0) of prefix words with the words that a window through them can reach."""
    found = F.expr(f"filter(transform(w, (x, i) -> struct(i AS pos, x AS word)), x -> {_in_set('x.word', prefix)})")
    reach = window - 1
    return F.transform(found, lambda x: F.struct(
        x["pos"].alias("pos"), x["word"].alias("word"), F.greatest(x["pos"] - reach, F.lit(0)).alias("first"),
        F.slice("w", F.greatest(x["pos"] - reach, F.lit(0)) + 1, 2 * reach + 1).alias("near")))


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
              words_per_pass: int = WORDS_PER_PASS, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (sorted strings), then ``carry`` columns."""
    windows = item_windows(items, docs, item_col, item_text, text_col, window, words_per_pass)
    prefixes = _passes(windows.select(F.col("prefix").alias("word")), words_per_pass)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("w"),
                       *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry or [])])
    near = [_near(rows, "w", p, window) for p in prefixes if p]
    base = keep(rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"),
        (F.concat(*near) if near else F.array().cast(
            "array<struct<pos:int,word:string,first:int,near:array<string>>>")).alias("near"),
        *[f"carry_{i}" for i in range(len(carry or []))]))
    place = base.select("row", "n_words", F.explode("near").alias("c")).select("row", "n_words", "c.*")
    distinct = windows.select("key", "words", "prefix", "offset").distinct()
    start = F.col("pos") - F.col("offset")
    size = F.size("words")
    hits = place.join(distinct, place["word"] == distinct["prefix"]).filter(
        (start >= 0) & (start + size <= F.col("n_words"))
        & (F.slice("near", start - F.col("first") + 1, size) == F.col("words"))
    ).select("row", start.alias("start"), (start + size).alias("end"), "key")
    # covered words: windows in order of start, each adds what lies beyond the farthest end so far
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    cover = hits.groupBy("row").agg(spans.alias("spans")).select("row", F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("far")), lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["far"]), F.lit(0))).alias("n"),
            F.greatest(a["far"], s["end"]).alias("far")))["n"].cast("long").alias("n_hit"))
    of_item = windows.filter(F.col("item_id").isNotNull()).select("key", "item_id").distinct()
    listed = hits.select("row", "key").distinct().join(of_item, "key").groupBy("row").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return base.drop("near").join(cover.join(listed, "row", "left"), "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry or [])])
