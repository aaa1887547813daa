"""URL filter: host and path rules, and gradient-boosted trees for URLs that no rule decides.

URLs that a rule decides are the labelled URLs.  Trees learn their verdicts from lexical features: lengths of URL,
host and path, depth, share of digits, character entropy, hyphens, parameter and
fragment counts, and statistics of the host's suffixes (share of blocked URLs among labelled ones
with the same last label, the same last two and three labels, and the same first path part, smoothed
towards the shares of all, so that a suffix seen once says little).

Features and rules are Column expressions and the trees are Spark's ``GBTClassifier``.  Suffix statistics are counted
over all labelled rows; the trees are fitted on at most ``train_rows`` distinct URLs of each verdict, by smallest hash of the URL
(the documented bound of the sample).  Every URL is scored.

Defined cases: a null URL or one without ``://`` has empty host and path, no rule, and the trees' verdict; equal URLs
get equal verdicts; null page_ids and repeated rows pass through, one result row each; an empty table gives none; with no
labelled URL, or one verdict only, the method's verdict is that verdict, or ``allow`` for none; extra columns
are not read.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._blocks import keep

#: (verdict, rule): host, then the start of the path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))
TRAIN_ROWS = 10_000
TREES, DEPTH = 20, 4
SMOOTHING = 10.0
SUFFIXES = ("tail1", "tail2", "tail3", "lead")
FEATURES = ("url_length", "host_length", "path_length", "depth", "digits", "entropy", "hyphens", "labels",
            "params", "fragment", "secure", *(f"{s}_share" for s in SUFFIXES))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, start = rule.split("/", 1)
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + start))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character."""
    letters = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = F.transform(F.array_distinct(letters),
                        lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(F.filter(share, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def with_features(urls: DataFrame) -> DataFrame:
    """Adds the lexical columns to rows with ``url``, ``host`` and ``path``."""
    url = F.coalesce("url", F.lit(""))
    parts = F.split("host", r"\.")
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    tail = [F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), k)) for k in (1, 2, 3)]
    return urls.select(
        "*", F.length(url).alias("url_length"), F.length("host").alias("host_length"),
        F.length("path").alias("path_length"), (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))))
        .alias("depth"), (digits / F.greatest(F.length(url), F.lit(1))).alias("digits"), _entropy(url).alias("entropy"),
        (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).alias("hyphens"),
        F.size(parts).alias("labels"),
        F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).alias("params"),
        F.contains(url, F.lit("#")).cast("int").alias("fragment"),
        F.startswith(F.lower(url), F.lit("https://")).cast("int").alias("secure"),
        *[t.alias(f"tail{k + 1}") for k, t in enumerate(tail)],
        F.regexp_extract("path", r"(?s)^/([^/]*)", 1).alias("lead"))


class UrlModel:
    """Suffix statistics of labelled URLs and the trees fitted on them; without both verdicts, a constant."""

    def __init__(self, stats: dict[str, DataFrame], overall: float, trees):
        self.stats, self.overall, self.trees = stats, overall, trees

    def _inputs(self, rows: DataFrame) -> DataFrame:
        for name, counts in self.stats.items():
            rows = rows.join(counts, name, "left")
            n, bad = F.coalesce(f"{name}_n", F.lit(0)), F.coalesce(f"{name}_bad", F.lit(0))
            rows = rows.withColumn(f"{name}_share", (bad + SMOOTHING * self.overall) / (n + SMOOTHING)) \
                .drop(f"{name}_n", f"{name}_bad")
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``blocked_probability`` to rows of :func:`with_features`."""
        if self.trees is None:
            return rows.withColumn("blocked_probability", F.lit(self.overall))
        scored = self.trees.setProbabilityCol("p").setRawPredictionCol("raw").transform(self._inputs(rows))
        return scored.withColumn("blocked_probability", vector_to_array("p")[1])


def sample_urls(labelled: DataFrame, train_rows: int) -> DataFrame:
    """(url, label): at most ``train_rows`` distinct URLs of each label, by smallest hash."""
    one, two = (labelled.filter(F.col("label") == kind).select("url", "label").distinct()
                .orderBy(F.xxhash64("url"), "url").limit(train_rows) for kind in (0, 1))
    return one.unionByName(two)


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH) -> UrlModel:
    """Model of labelled URLs: rows of :func:`with_features` with ``label`` (1: block)."""
    # rows per distinct suffix, pre-aggregated before the shuffle
    stats = {s: keep(labelled.groupBy(s).agg(F.count("*").alias(f"{s}_n"), F.sum("label").alias(f"{s}_bad")))
             for s in SUFFIXES}
    total = stats["tail1"].agg(F.sum("tail1_n"), F.sum("tail1_bad")).first()
    n, bad = int(total[0] or 0), int(total[1] or 0)
    model = UrlModel(stats, bad / n if n else 0.0, None)
    if not 0 < bad < n:
        return model
    host, path = split_url(F.col("url"))
    rows = model._inputs(with_features(sample_urls(labelled, train_rows).withColumns({"host": host, "path": path})))
    # the bounded sample in a fixed order and few partitions, so that every run fits the same trees
    rows = keep(rows.select("features", F.col("label").cast("double").alias("label"), "url")
                .orderBy("label", F.xxhash64("url"), "url").coalesce(2))
    model.trees = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, maxBins=64, cacheNodeIds=False).fit(rows)
    return model


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
                train_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(page_id, host, path, rule, verdict, blocked_probability) of every row."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    base = base.withColumns({"host": host, "path": path})
    base = with_features(base.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)))
    labelled = base.filter("r IS NOT NULL").withColumn("label", (F.col("r.verdict") == "block").cast("int"))
    out = train(labelled, train_rows, trees, depth).score(base)
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("blocked_probability") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"),
                      "blocked_probability")
