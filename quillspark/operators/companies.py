"""Company master operators: de-duplication, search, ticker resolution, term selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.patterns import UNKNOWN_COMPANY
from ..functions.text import zero_fill
from ..session import cut_lineage


def dedup_companies(raw: DataFrame) -> DataFrame:
    """A1 + P1 + P2 + P11: one row per ticker, last record wins.

    ``raw`` has ``ticker, cik_str, title, src_pos``.  A dict keeps a key at the
    position it was first inserted but takes the value last written, so the
    order key is ``min(src_pos)`` and the values come from ``max_by(src_pos)``.
    Both are partial aggregates: a ticker repeated across a third of the input
    is combined map-side before the shuffle.
    """
    valid = raw.where(F.col("ticker").isNotNull() & F.col("cik_str").isNotNull())
    last = F.max_by(F.struct("cik_str", "title"), "src_pos")
    agg = valid.groupBy("ticker").agg(last.alias("v"), F.min("src_pos").alias("first_pos"))
    return agg.select(
        "ticker",
        zero_fill(F.col("v.cik_str")).alias("cik"),
        F.coalesce(F.col("v.title"), F.lit(UNKNOWN_COMPANY)).alias("title"),
        "first_pos")


def search_companies(companies: DataFrame, term: str | None = None, limit: int | None = 50) -> DataFrame:
    """P6 + O1: case-insensitive substring search on ticker or title, sorted by ticker.

    ``limit`` 0/None returns every match (a global sort, range-partitioned).
    """
    df = companies
    if term:
        t = term.lower()
        df = df.where(F.lower("ticker").contains(t) | F.lower("title").contains(t))
    df = df.orderBy("ticker")
    return df.limit(limit) if limit else df


def resolve_tickers(requested: DataFrame, companies: DataFrame) -> DataFrame:
    """Requested tickers joined to the master, exact and case-sensitive; keeps ``req_pos``."""
    return requested.join(companies, "ticker", "inner")


def unknown_tickers(requested: DataFrame, companies: DataFrame) -> DataFrame:
    """Requested tickers absent from the master (the reference warns and skips them)."""
    return requested.join(companies.select("ticker"), "ticker", "left_anti")


GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(size))))) \
        .otherwise(F.array().cast("array<string>"))


def match_titles(companies: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_pos, term, and all columns of ``companies``) where the lower-cased title contains ``term`` (lower case).

    An index join instead of a comparison of all pairs: titles are posted under their trigrams, each term asks under the
    rarest of its own, and what meets there is compared exactly.  Terms of one or two characters ask under
    themselves, an empty term under every title.  Only trigrams that some term has are posted.
    """
    title = F.lower("title")
    term_grams = terms.select("term_pos", "term", F.least(F.length("term"), F.lit(GRAM)).alias("size"))
    term_grams = term_grams.select("term_pos", "term", F.explode(
        F.when(F.col("size") == 0, F.array(F.lit(""))).otherwise(
            F.coalesce(*[F.when(F.col("size") == n, _grams(F.col("term"), n)) for n in range(1, GRAM + 1)]))).alias("gram"))
    posted = companies.select("*", F.explode(F.concat(
        F.array(F.lit("")), *[_grams(title, n) for n in range(1, GRAM + 1)])).alias("gram"))
    asked = term_grams.select("gram").distinct()
    counts = posted.select("gram").join(asked, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no title has rules its term out
    rarest = term_grams.join(counts, "gram", "left").groupBy("term_pos", "term").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).filter("g.n > 0")
    return posted.join(rarest.select("term_pos", "term", F.col("g.gram").alias("gram")), "gram") \
        .filter(F.lower("title").contains(F.col("term"))).select("term_pos", "term", *companies.columns)


def greedy_match(candidates: DataFrame) -> DataFrame:
    """Of candidates (term_pos, rank, ticker), the ticker that each term gets: terms take, in order, their first
    candidate by ``rank`` that no earlier term has.

    In rounds of joins: each term without a company proposes its first one that no earlier term holds, and a company keeps the
    earliest term that proposed.  What an earlier term holds can only pass to one earlier still, so no proposal needs to be
    repeated, and the end is the serial result.  A round is one join and two partial minima over tables of keys.
    The number of rounds is the longest chain of terms that displace each other (terms whose candidate lists all begin alike
    settle one company a round).
    """
    candidates = cut_lineage(candidates.select("term_pos", "rank", "ticker"))
    held = cut_lineage(candidates.limit(0).select("ticker", "term_pos"))
    while True:
        free = candidates.join(held.select("term_pos"), "term_pos", "left_anti").join(
            held.select("ticker", F.col("term_pos").alias("holder")), "ticker", "left") \
            .filter(F.col("holder").isNull() | (F.col("holder") > F.col("term_pos")))
        proposed = cut_lineage(free.groupBy("term_pos").agg(F.min_by("ticker", "rank").alias("ticker")))
        if proposed.isEmpty():
            return held
        held = cut_lineage(held.unionByName(proposed.select("ticker", "term_pos")).groupBy("ticker").agg(
            F.min("term_pos").alias("term_pos")))


def select_companies(companies: DataFrame, terms: Sequence[str], order_col: str = "first_pos") -> DataFrame:
    """J4 + W4: for each search term in order, the first company (in master order)
    whose lower-cased title contains it, never re-using a ticker.

    The term at position ``i`` can lose at most ``i`` candidates to earlier terms, so its first ``i + 1`` candidates
    (``row_number`` per term, planned as a partial group limit) always contain the answer; and where a text is a term for the
    j-th time, its earlier terms have the candidates before the j-th.
    """
    spark: SparkSession = companies.sparkSession
    rows, seen = [], {}
    for i, t in enumerate(terms):
        t = t.lower()
        rows.append((i, t, seen.setdefault(t, 0)))
        seen[t] += 1
    term_df = spark.createDataFrame(rows, "term_pos int, term string, earlier int")
    # one search per text; repeated terms share its candidates
    texts = term_df.groupBy("term").agg(F.max("term_pos").alias("term_pos"))
    found = match_titles(companies.select("ticker", "title", order_col), texts)
    by = Window.partitionBy("term").orderBy(order_col, "ticker")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= len(rows)).select(
        "term", "rank", "ticker", "title")
    cand = cut_lineage(ranked.join(term_df, "term").where(
        (F.col("rank") <= F.col("term_pos") + 1) & (F.col("rank") > F.col("earlier"))))
    return greedy_match(cand).join(cand, ["term_pos", "ticker"]).select("term_pos", "term", "ticker", "title")
