"""Toxicity by maximum-scoring segments.

Token log-odds between toxic and other labelled texts, shrunk by an informative Dirichlet prior, are the scores of a
linear-time scan that finds every maximal scoring segment of a text. The best segment's score is turned into a tail
probability by the extreme-value law of clean texts' best segments, given the text's length, and a logistic curve over
these gives a score from 0 to 1.

A word is scored by its own weight or, where it was too rare, by the longest of its beginnings that has one, so that
inflected forms share what was learned of their stem.

Defined cases. A null or empty text has no segments and gets the score of such a text, near 0. Rows without a label
are scored like all others. Without labelled rows of both classes every score is 0. A null doc_id is not held out.
Very long texts are scanned whole. Of labels that repeat a doc_id the toxic one
counts. A model is fitted on SAMPLE_ROWS labelled doc_ids at most, has TABLE_ROWS weights at most, and where documents
repeat doc_ids takes four times as many rows as that for its tail and curve at most; all rows are scored. Tokens of equal weight and segments of equal score need no order: only sums and the highest score are used. An
empty table gives no rows. Repeated rows get equal scores. Extra columns are kept; __score columns are reserved.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from brinewave.llm.common import fold, give_back, materialize, portions, table

SAMPLE_ROWS = 20_000  # labelled rows that the fit takes at most
TABLE_ROWS = 50_000  # weights that a model has at most: those with the greatest |z|
PREFIXES = (8, 7, 6, 5, 4)
EDGE = ".,;:!?\"'()[]{}<>%&*$#|-"
DRIFT = 1.0  # what each token costs, so that a segment must be dense in toxic tokens
LEAST_Z = 2.5
LEAST_COUNT = 4
PARTS = 3  # of the labelled rows: each is scored by weights from the others, to fit the tail and the curve
CACHE = 200_000


def tokens_of(word: str) -> list[str]:
    """A word's tokens, the most special first: the whole word, then its beginnings."""
    w = word.lower().strip(EDGE)
    return [f"={w}", *(f"{w[:k]}*" for k in PREFIXES if len(w) >= k)] if w else []


def count_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (token, part, toxic, other): occurrences by class, summed over what the task sees."""
    by: dict[tuple[int, int], Counter] = {}

    def flush() -> pd.DataFrame:
        rows = [(t, part, n if label else 0, 0 if label else n) for (part, label), c in by.items() for t, n in c.items()]
        by.clear()
        return pd.DataFrame(rows, columns=["token", "part", "toxic", "other"])

    for pdf in batches:
        for text, label, part in zip(pdf["text"], pdf["__toxic"], pdf["__part"], strict=True):
            c = by.setdefault((int(part), int(label == 1)), Counter())
            for word, n in Counter((text or "").split()).items():
                for t in tokens_of(word):
                    c[t] += n
            if sum(map(len, by.values())) > 200_000:
                yield flush()
    yield flush()
    give_back()


def log_odds(counts: DataFrame, *, prior: float = 0.05, least_z: float = LEAST_Z, limit: int = TABLE_ROWS) -> DataFrame:
    """(token, weight, z): log-odds ratio with an informative Dirichlet prior; at most limit tokens, by |z|.

    Whole words and beginnings of each length are families of their own, each with its own totals; the prior is the
    background distribution of the family, worth the share prior of its occurrences.
    """
    c = counts.withColumn("family", F.when(F.col("token").startswith("="), F.lit(0)).otherwise(F.length("token") - 1))
    total = c.groupBy("family").agg(F.sum("toxic").alias("n1"), F.sum("other").alias("n0"))
    both = F.col("toxic") + F.col("other")
    a = F.lit(prior) * both
    odds = lambda y, n: F.log((y + a) / (n + F.lit(prior) * (F.col("n1") + F.col("n0")) - y - a))
    c = c.join(F.broadcast(total), "family").where((both >= LEAST_COUNT) & (F.col("n1") > 0) & (F.col("n0") > 0))
    c = c.withColumn("weight", odds(F.col("toxic"), F.col("n1")) - odds(F.col("other"), F.col("n0")))
    c = c.withColumn("z", F.col("weight") / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("other") + a)))
    return c.where(F.abs("z") >= least_z).select("token", "weight", "z").orderBy(F.abs("z").desc(), "token").limit(limit)


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of a sequence, end exclusive, by the linear-time scan.

    Runs of equal sign are joined first, since no maximal segment ends inside one.
    """
    if not (scores > 0).any():
        return []
    sign = scores > 0
    cut = np.flatnonzero(np.r_[True, sign[1:] != sign[:-1]])
    sums = np.add.reduceat(scores, cut)
    ends = np.r_[cut[1:], len(scores)]
    total = 0.0
    found: list[list[float]] = []  # left sum, right sum, start, end
    for k in range(len(cut)):
        s = float(sums[k])
        if s <= 0:
            total += s
            continue
        new = [total, total + s, int(cut[k]), int(ends[k])]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j -= 1
            if j < 0 or found[j][1] >= new[1]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(b - a, int(i), int(k)) for a, b, i, k in found]


@dataclass
class Scorer:
    """Word scores from a table of weights."""

    weights: dict[str, float]

    def __post_init__(self) -> None:
        self.cache: dict[str, float] = {}

    def word(self, word: str) -> float:
        s = self.cache.get(word)
        if s is None:
            s = next((self.weights[t] for t in tokens_of(word) if t in self.weights), 0.0) - DRIFT
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = s
        return s

    def text(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        """(number of words, maximal segments over word positions)."""
        words = (text or "").split()
        return len(words), segments(np.fromiter(map(self.word, words), float, len(words))) if words else []


@dataclass
class Model:
    """weights: token -> log-odds; tail: a clean text's best segment in n words exceeds s with 1 - exp(-k n exp(-rate s)); curve: intercept and slopes of the logistic."""

    weights: dict[str, float]
    rate: float = 1.0
    k: float = 1.0
    curve: tuple[float, float, float] = (-50.0, 0.0, 0.0)

    def evidence(self, score: float, n: int) -> float:
        """-log10 of the tail probability of a best segment, at most 300."""
        e = math.log(self.k * max(n, 1)) - self.rate * score
        tail = -math.expm1(-math.exp(min(e, 50.0))) if e > -30 else math.exp(max(e, -690.0))
        return -math.log10(max(tail, 1e-300))

    def summary(self, n: int, found: list[tuple[float, int, int]], level: float = 2.0) -> tuple[float, int, float, float]:
        """(best segment's score, significant segments, their total score, evidence of the best)."""
        best = max((s for s, _, _ in found), default=0.0)
        good = [s for s, _, _ in found if self.evidence(s, n) >= level]
        return best, len(good), float(sum(good)), self.evidence(best, n) if found else 0.0

    def probability(self, evidence: np.ndarray, count: np.ndarray) -> np.ndarray:
        b, e, c = self.curve
        return 1 / (1 + np.exp(-np.clip(b + e * np.minimum(evidence, 12) + c * np.log1p(count), -50, 50)))


def tail_of(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(rate, k) of the extreme-value law from clean texts' best segments: Gumbel moments of score - log(n) / rate, by a few fixed-point steps."""
    rate = 1.0
    if len(best) < 10:
        return 1.0, 1e-3
    logn = np.log(np.maximum(n, 1))
    for _ in range(30):
        x = best - logn / rate
        rate = float(np.clip(math.pi / (math.sqrt(6) * max(float(x.std()), 1e-3)), 0.2, 3.0))
    x = best - logn / rate
    mode = float(x.mean()) - 0.5772156649 / rate
    return rate, math.exp(min(max(rate * mode, -50.0), 50.0))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression with intercept, by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, use: Column | None = None) -> Model:
    """Learn from at most sample_rows labelled rows: weights from all of them, tail and curve from scores by weights that
    come from the other parts.

    use: which labels may be learned from.
    """
    spark = documents.sparkSession
    chosen = labels.where("doc_id is not null and toxic is not null")
    chosen = (chosen if use is None else chosen.where(use)).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("text", "__toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)).cast("int").alias("__part"))
    counts = rows.mapInPandas(count_tokens, "token string, part int, toxic long, other long")
    counts = materialize(counts.groupBy("token", "part").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "tokens")

    def weights_without(part: int) -> dict[str, float]:
        c = counts.where(F.col("part") != part).groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        return {r.token: r.weight for r in log_odds(c).collect()}

    others, weights = [weights_without(k) for k in range(PARTS)], weights_without(-1)
    shared = spark.sparkContext.broadcast(others)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(w) for w in shared.value]
        for pdf in batches:
            done = [scorers[k].text(x) for x, k in zip(pdf["text"], pdf["__part"], strict=True)]
            scores = [[s for s, _, _ in f] for _, f in done]
            yield pd.DataFrame({"toxic": pdf["__toxic"].astype("int32"), "n": [n for n, _ in done], "scores": scores})
        scorers.clear()
        give_back()

    held = rows.mapInPandas(scan, "toxic int, n long, scores array<double>").limit(4 * sample_rows).toPandas()
    if not weights or held["toxic"].nunique() < 2:
        return Model(weights={})
    y, n = held["toxic"].to_numpy(), held["n"].to_numpy(float)
    best = np.array([max(s) if len(s) else 0.0 for s in held["scores"]])
    rate, k = tail_of(best[(y == 0) & (n > 0)], n[(y == 0) & (n > 0)])
    model = Model(weights, rate, k)
    evidence = np.array([model.evidence(b, m) if b > 0 else 0.0 for b, m in zip(best, n, strict=True)])
    count = np.array([sum(model.evidence(s, m) >= 2.0 for s in ss) for ss, m in zip(held["scores"], n, strict=True)])
    w = logistic(np.column_stack([np.minimum(evidence, 12), np.log1p(count)]), y.astype(float))
    model.curve = (float(w[0]), float(w[1]), float(w[2]))
    return model


def score(documents: DataFrame, model: Model, *, spans: bool = False) -> DataFrame:
    """The documents with score, best_segment, n_segments and evidence; with spans, also each significant segment's words."""
    if not model.weights:
        zero = {"score": F.lit(0.0), "best_segment": F.lit(0.0), "n_segments": F.lit(0), "evidence": F.lit(0.0)}
        return documents.withColumns(zero | ({"segments": F.array().cast("array<struct<start:int,end:int,score:double>>")} if spans else {}))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = "score double, best_segment double, n_segments int, evidence double" + (", segments array<struct<start:int,end:int,score:double>>" if spans else "")

    names = ["score", "best_segment", "n_segments", "evidence", *(["segments"] if spans else [])]

    @arrow_udf(kind)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        scorer = Scorer(m.weights)
        try:
            for texts in chain.from_iterable(map(portions, batches)):
                done = [scorer.text(x) for x in texts]
                sums = [m.summary(n, found) for n, found in done]
                count, evidence = np.array([s[1] for s in sums], float), np.array([s[3] for s in sums], float)
                out = [pa.array(m.probability(evidence, count)), pa.array([s[0] for s in sums], pa.float64()), pa.array([s[1] for s in sums], pa.int32()), pa.array(evidence)]
                if spans:
                    spanned = [[{"start": a, "end": b, "score": s} for s, a, b in found if m.evidence(s, n) >= 2.0] for n, found in done]
                    out.append(pa.array(spanned, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))))
                yield pa.StructArray.from_arrays(out, names)
        finally:
            scorer.cache.clear()
            give_back()

    out = documents.withColumn("__score", scan(F.col("text")))
    return out.withColumns({c: F.col(f"__score.{c}") for c in names}).drop("__score")


def held_out() -> Column:
    return F.coalesce(fold("doc_id", 3) == 1, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels"), use=~held_out())
    scored = score(documents, model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "best_segment", "n_segments", "evidence"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.7. Null and blank texts score near 0 and stay; other odd rows as in the module; the columns are those of docs."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select(F.struct(*docs.columns).alias("__row"), "text"), model).where("score < 0.7").select("__row.*")
