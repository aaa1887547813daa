"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of word classes (insult, threat, target, negation, reported speech, other).  Three
small transducers mark what holds at each insult or threat: a negation just before it, a
reporting verb or an opening quote earlier in the clause, a target anywhere in it.  They are composed into
one table; a document is scored by its matched clauses (kind of match times the marks), not by isolated words.

The lexicon is a short fixed list and words, and word beginnings, that labelled texts show to
be toxic (log-likelihood ratio of document counts).  The weights of the 16 match kinds are a logistic
regression whose prior is the grammar's own weights, so a kind that the labels never show keeps its sense.  While the
weights are fitted, each half of the sample is read with the lexicon of the other half.

Bound of the sample: at most ``toxic_rows`` and ``clean_rows`` labelled training rows, by smallest hash of their id (ids only: the labels
table is small next to the texts); rows are weighted back to the label counts.  Every document is scored whole.

Defined cases: null and empty texts have no clause and get the score of a text without matches; null ids are not held out
and have no label; a doc_id with several labels counts as toxic if any is; null labels are left out; with no labelled rows the
prior stands alone; repeated rows give one row each; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark._ship import ship_package
from quillspark.llm._blocks import split_words, text_runs

FOLDS, HELD_FOLD = 3, 1
THRESHOLD = 0.7
TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
MIN_LLR, MIN_STEM_LLR, STEM = 20.0, 40.0, (4, 5, 6, 7, 8)
STEM_WORDS = 3                 # words of toxic texts that a beginning must stand for
MAX_LEXICON = 20_000
SCHEMA = "doc_id long, score double"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
# Fixed word lists of the grammar (English, German, French, Spanish).
INSULTS = ("idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting clown clowns imbecile "
           "dumb retard freak vermin dummkopf idioten abschaum imbécile crétin abruti idiota estúpido imbécil").split()
THREATS = ("kill murder strangle stab shoot hurt destroy smash umbringen töten erschießen tuer égorger matar "
           "matarte destrozar").split()
TARGETS = ("you your yours yourself u he she him her they them these those everyone people du dich dir euch ihr "
           "tu toi vous te usted ustedes eres").split()
NEGATIONS = "not never isn't aren't wasn't don't without hardly nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = ("said says say called calls call wrote writes claimed claims quoted quote reported sagte sagt nannte dit "
           "disait appelé dijo dice llamó").split()
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n]|[\"“„«]")
_END = frozenset(".!?;\n")
_QUOTES = frozenset("\"“„«")


# --- transducers -----------------------------------------------------------------------------

def negation_machine() -> tuple[int, dict]:
    """State: words left in the scope of a negation.  Output 1 at a match inside it."""
    return 3, {(s, c): (2 if c == NEGATION else max(s - 1, 0), int(s > 0)) for s in range(3) for c in range(6)}


def report_machine() -> tuple[int, dict]:
    """State 1 from a reporting word to the end of the clause."""
    return 2, {(s, c): (int(s or c == REPORT), s) for s in range(2) for c in range(6)}


def target_machine() -> tuple[int, dict]:
    """State 1 once the clause has named a target; read at its end."""
    return 2, {(s, c): (int(s or c == TARGET), 0) for s in range(2) for c in range(6)}


def compose(*machines) -> tuple[dict[tuple[int, int], tuple[int, int]], dict[int, tuple]]:
    """One table {(state, class): (next state, mark bits)} of machines that read the same classes."""
    states = list(product(*(range(n) for n, _ in machines)))
    number = {s: i for i, s in enumerate(states)}
    table = {}
    for s in states:
        for c in range(6):
            steps = [m[x, c] for x, (_, m) in zip(s, machines, strict=True)]
            bits = sum(out << i for i, (_, out) in enumerate(steps))
            table[number[s], c] = (number[tuple(n for n, _ in steps)], bits)
    return table, dict(enumerate(states))


TABLE, STATES = compose(negation_machine(), report_machine(), target_machine())
#: Feature of a match: 8 * (is a threat) + 4 * targeted + 2 * reported + negated.
FEATURES = 16
PRIOR = np.array([math.log(9) * w for w in
                  (1.6, 0.3, 0.6, 0.2, 2.2, 0.4, 0.8, 0.2, 0.2, 0.0, 0.1, 0.0, 1.6, 0.2, 0.6, 0.1)])
PRIOR_BIAS = -2.5


class Lexicon:
    """Class and weight of a word: the word itself, else its learned beginning."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words = {w: (OTHER, 0.0) for w in ()}
        for names, kind in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            self.words |= {w: (kind, 0.0) for w in names}
        learned = {w: (INSULT, p) for w, p in words.items() if w not in self.words and w not in THREATS}
        self.words |= learned | {w: (THREAT, 1.0) for w in THREATS} | {w: (INSULT, 1.0) for w in INSULTS}
        self.stems = stems
        self.seen: dict[str, tuple[int, float]] = {}          # other words of the texts at hand

    def of(self, word: str) -> tuple[int, float]:
        got = self.words.get(word) or self.seen.get(word)
        if got is None:
            got = (OTHER, 0.0)
            for n in STEM:
                if word[:n] in self.stems and len(word) >= n:
                    got = (INSULT, self.stems[word[:n]])
            self.seen[word] = got
        return got

    def matches(self, word: str) -> bool:
        """Whether a run of non-blank characters can hold a match."""
        return any(self.of(w)[0] in (INSULT, THREAT) for w in _TOKEN.findall(word))


def clause_features(text: str, lexicon: Lexicon) -> np.ndarray:
    """log(1 + summed lexicon weight) of each match kind over the clauses of a lower-cased text."""
    sums = np.zeros(FEATURES)
    state, found = 0, []
    for token in _TOKEN.findall(text):
        if token in _END:
            if found:
                _close(sums, found, state)
                found = []
            state = 0
            continue
        kind, weight = (REPORT, 0.0) if token in _QUOTES else lexicon.of(token)
        state, bits = TABLE[state, kind]
        if kind in (INSULT, THREAT):
            found.append((kind, bits, weight))
    if found:
        _close(sums, found, state)
    return np.log1p(sums)


def _close(sums: np.ndarray, found: list, state: int) -> None:
    targeted = STATES[state][2]
    for kind, bits, weight in found:
        sums[8 * (kind == THREAT) + 4 * targeted + (bits & 3)] += weight


def text_features(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a possible match, their features)."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    flat, n = split_words(low)
    code = flat.dictionary_encode()
    hit = np.array([lexicon.matches(w) for w in code.dictionary.to_pylist()], bool)
    at = np.repeat(np.arange(len(n)), n)[hit[code.indices.to_numpy(zero_copy_only=False)]] if len(hit) else []
    rows = np.unique(np.asarray(at, np.int64))
    feats = [clause_features(low[i].as_py(), lexicon) for i in rows.tolist()]
    return rows, np.array(feats).reshape(len(rows), FEATURES)


# --- learning --------------------------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))


def labelled_ids(labels: DataFrame, toxic_rows: int, clean_rows: int) -> tuple[list, dict[int, float]]:
    """A bounded list (doc_id, toxic, half) of training rows and the weight of a row of each class."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    total = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = [(r["doc_id"], kind, int(r["h"]) & 1) for kind, most in ((1, toxic_rows), (0, clean_rows))
            for r in one.filter(F.col("toxic") == kind).orderBy(order, "doc_id").limit(most)
            .select("doc_id", order.alias("h")).collect()]
    n = {k: sum(r[1] == k for r in rows) for k in (0, 1)}
    return rows, {k: total.get(k, 0) / max(n[k], 1) for k in (0, 1)}


def _llr(n1, n0, all1, all0):
    """Signed log-likelihood ratio of a word's document counts against independence; positive: toxic."""
    def term(k, n, p):
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * math.log(p) + (n - k) * math.log(1 - p)
    pooled = (n1 + n0) / (all1 + all0)
    ratio = 2 * (term(n1, all1, n1 / all1) + term(n0, all0, n0 / all0)
                 - term(n1, all1, pooled) - term(n0, all0, pooled))
    return ratio if n1 / all1 > n0 / all0 else -ratio


def _beginnings(words: Column, k: int) -> Column:
    """``k:<first k letters>`` of every word that long."""
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= k),
                                        lambda w: F.concat(F.lit(f"{k}:"), F.substring(w, 1, k))))


def count_words(sample: DataFrame) -> tuple[dict, list]:
    """Documents by (toxic, half), and those of every word or beginning that leans to toxic texts."""
    n = {(r["toxic"], r["half"]): r["n"] for r in sample.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    all1, all0 = (sum(n.get((k, h), 0) for h in (0, 1)) for k in (1, 0))
    low = F.lower(F.coalesce("text", F.lit("")))
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\p{L}+"), 0))
    # (a lambda's second parameter would be the index, so the length is bound by a function)
    stems = [_beginnings(words, k) for k in STEM]
    each = sample.select("toxic", "half", F.explode(F.concat(words, *stems)).alias("w"))
    cells = [F.count(F.when((F.col("toxic") == k) & (F.col("half") == h), 1)).alias(f"n{k}{h}")
             for k in (0, 1) for h in (0, 1)]
    one, zero = F.col("n10") + F.col("n11"), F.col("n00") + F.col("n01")
    rows = each.groupBy("w").agg(*cells).filter((one >= 3) & (one * all0 > 4 * zero * all1))
    # in how many contexts (words before it) toxic texts use a word: copies of one text have few, however many they are
    toks = sample.filter("toxic = 1").select(F.regexp_extract_all(low, F.lit(r"\p{L}+"), 0).alias("t"))
    pairs = toks.select(F.explode(F.transform("t", lambda w, i: F.struct(
        w.alias("word"), F.get("t", i - 1).alias("before")))).alias("p")).select("p.*").distinct()
    starts = [F.when(F.length("word") >= k, F.concat(F.lit(f"{k}:"), F.substring("word", 1, k))) for k in STEM]
    spread = pairs.select("word", F.explode(F.array("word", *starts)).alias("w")).filter("w IS NOT NULL")
    uses = spread.groupBy("w", "word").agg(F.count("*").alias("c")).groupBy("w").agg(
        F.sum("c").alias("contexts"), F.count("*").alias("words"))
    rows = rows.join(uses, "w").filter(2 * F.col("contexts") >= one)
    return n, rows.orderBy(F.desc(one / (zero + 1)), "w").limit(MAX_LEXICON).collect()


def pick_lexicon(counts: tuple[dict, list], halves: tuple[int, ...], weight: dict[int, float]) -> Lexicon:
    """Words and beginnings that mark toxic texts in the given halves of the sample."""
    n, rows = counts
    all1, all0 = (sum(n.get((k, h), 0) for h in halves) for k in (1, 0))
    found, stem = {}, {}
    for r in rows if all1 and all0 else []:
        n1, n0 = (sum(r[f"n{k}{h}"] for h in halves) for k in (1, 0))
        ratio = _llr(n1, n0, all1, all0)
        p = (n1 * weight[1]) / ((n1 + 0.5) * weight[1] + (n0 + 0.5) * weight[0])
        name = r["w"].split(":")[-1]
        if ":" in r["w"] and ratio >= MIN_STEM_LLR and p > 0.9 and r["words"] >= STEM_WORDS:
            stem[name] = p
        elif ":" not in r["w"] and ratio >= MIN_LLR and p > 0.8:
            found[name] = p
    return Lexicon(found, stem)


def fit_weights(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with a Gaussian prior at the grammar's weights (Newton's method)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    prior = np.concatenate([PRIOR, [PRIOR_BIAS]])
    strength = np.concatenate([np.full(FEATURES, 0.5), [0.01]])

    def loss(b):
        z = x @ b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (strength * (b - prior) ** 2).sum())
    beta = prior.copy()
    for _ in range(100 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + strength * (beta - prior)
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(strength)
        step, size = np.linalg.solve(hess, grad), 1.0
        # the step is halved until the loss falls: a full one can overshoot where p is near 0 or 1
        while loss(beta - size * step) > loss(beta) and size > 1e-10:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        rows, x = text_features(texts, self.lexicon)
        self.lexicon.seen.clear()
        z = np.full(len(texts), self.bias)
        z[rows] += x @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    spark = docs.sparkSession
    ship_package(spark)
    ids, weight = labelled_ids(labels, toxic_rows, clean_rows)
    picked = spark.createDataFrame(ids, "label_id long, toxic int, half int") if ids else \
        spark.createDataFrame([], "label_id long, toxic int, half int")
    # at most toxic_rows + clean_rows ids: a broadcast of bounded size
    sample = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text")) \
        .join(F.broadcast(picked), "label_id")
    counts = count_words(sample)
    # features of each half under the lexicon of the other; the model's own lexicon uses both
    other = spark.sparkContext.broadcast([pick_lexicon(counts, (h,), weight) for h in (1, 0)])

    def features(batches):
        for batch in batches:
            half = batch.column(2).to_numpy()
            full = np.zeros((batch.num_rows, FEATURES))
            for h in (0, 1):
                own = np.flatnonzero(half == h)
                rows, x = text_features(batch.column(0).take(pa.array(own)), other.value[h])
                full[own[rows]] = x
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(full), pa.list_(pa.float64()))],
                                             names=["toxic", "x"])
    got = sample.select("text", "toxic", "half").mapInArrow(features, "toxic int, x array<double>").toArrow()
    y = got["toxic"].to_numpy().astype(float)
    x = np.array(got["x"].to_pylist(), float).reshape(len(y), FEATURES)
    weights, bias = fit_weights(x, y, np.where(y > 0, weight[1], weight[0]) if len(y) else y)
    return Model(pick_lexicon(counts, (0, 1), weight), weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in text_runs(batches):
            part = part.combine_chunks()
            yield pa.RecordBatch.from_arrays([part.column(0).chunk(0), pa.array(held.value.scores(part.column(1).chunk(0)))],
                                             names=["doc_id", "score"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose text scores under ``threshold``, all columns as they were."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for part in text_runs(batches, at=at):
            for batch in part.combine_chunks().to_batches():
                yield batch.filter(pa.array(held.value.scores(batch.column(at)) < threshold))
    return docs.mapInArrow(run, docs.schema)
