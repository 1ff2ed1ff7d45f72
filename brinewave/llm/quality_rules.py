"""Quality rules: a decision list learned by sequential covering.

`text_stats` measures every whole text, `fit` grows and prunes conjunctions of thresholds on a bounded sample of
labelled statistics, and `DecisionList.verdict` is the ordered Spark conditional expression that applies them to any
number of rows without Python.

Defined cases. Null and empty texts count as no words, so they fail the base rule. Null labels are left out of the
training. Without labelled rows, or with one class only, the list is empty and keeps all that passes the base rule.
Of conditions with equal gains the first in the order of the
features, and of its thresholds the lowest, is taken. Very long texts are measured whole, one at a time; an empty table
gives no rows. Repeated rows get equal verdicts. The list is learned from SAMPLE_ROWS labelled doc_ids at most, and where documents repeat
doc_ids from four times as many rows at most; all rows are judged. Extra columns are kept; columns of the input named as a statistic, base_failed, rule or
kept are replaced, and one named __stats is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from brinewave.llm.common import WHITE, give_back, portions, table

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_exclaim", "n_stops")
STATS = BASE + EXTRA
STATS_TYPE = ", ".join(f"{c} long" for c in STATS)

#: Labelled rows that the fit takes at most, those with the smallest hash of their id.
SAMPLE_ROWS = 20_000

#: name -> statistic per unit; each is a Spark column of the statistics and, by the same formula, a numpy array.
RATIOS: dict[str, tuple[str, str]] = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "exclaims_per_word": ("n_exclaim", "n_words"),
    "stops_per_word": ("n_stops", "n_words"),
}


def repeat_words(words: list[bytes]) -> int:
    """Words within windows of three words that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n)
    k = np.uint64(len(seen))
    pair = ids[:-1] * k + ids[1:]
    if len(seen) >= 1 << 21:  # three ids no longer fit into 64 bits: number the pairs first
        pair = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
    window = pair[:-1] * k + ids[2:]
    _, at, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = count[at] > 1
    mark = np.zeros(n, bool)
    mark[:-2] |= twice
    mark[1:-1] |= twice
    mark[2:] |= twice
    return int(mark.sum())


def stats_of(text: str | None) -> tuple[int, ...]:
    """The statistics of one whole text, in the order of STATS."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the white space of WHITE
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    return (
        len(words),
        len(text) - without(WHITE),
        without(SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        without(UPPER),
        without(DIGITS),
        raw.count(b"!"),
        raw.count(b"."),
    )


def text_stats(text: Column) -> Column:
    """A struct of the statistics of a text column."""

    @arrow_udf(STATS_TYPE)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in chain.from_iterable(map(portions, batches)):
            rows = np.array([stats_of(x) for x in texts], np.int64)
            yield pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATS))], list(STATS))
        give_back()

    return measure(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def ratio_columns(of: Callable[[str], Column] = F.col) -> dict[str, Column]:
    return {"n_words": of("n_words").cast("double")} | {
        name: F.when(of(b) > 0, of(a) / of(b)).otherwise(F.lit(0.0)) for name, (a, b) in RATIOS.items()
    }


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions: (feature, '<=' or '>', threshold)."""

    conditions: tuple[tuple[str, str, float], ...]
    covered: int = 0
    precision: float = 0.0

    def matches(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, at in self.conditions:
            out &= x[name] <= at if op == "<=" else x[name] > at
        return out

    def column(self, features: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, at in self.conditions:
            out = out & (features[name] <= F.lit(at) if op == "<=" else features[name] > F.lit(at))
        return out


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default=())

    def verdict(self, features: dict[str, Column]) -> Column:
        """True if a row is kept: the first rule that matches rejects, what matches none is kept."""
        chain = None
        for r in self.rules:
            chain = F.when(r.column(features), F.lit(False)) if chain is None else chain.when(r.column(features), F.lit(False))
        return F.lit(True) if chain is None else chain.otherwise(F.lit(True))

    def rule_number(self, features: dict[str, Column]) -> Column:
        """The number of the rule that decides, from 1; 0 if none does."""
        chain = None
        for k, r in enumerate(self.rules, 1):
            chain = F.when(r.column(features), F.lit(k)) if chain is None else chain.when(r.column(features), F.lit(k))
        return F.lit(0) if chain is None else chain.otherwise(F.lit(0))

    def __str__(self) -> str:
        said = [f"if {' and '.join(f'{n} {o} {a:.6g}' for n, o, a in r.conditions)}: reject ({r.covered} rows, {r.precision:.3f})" for r in self.rules]
        return "\n".join([*said, "else: keep"])


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """FOIL's information gain of covering p bad and n good rows instead of p0 and n0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, out, -np.inf)


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray]) -> tuple[float, tuple[str, str, float] | None]:
    p0, n0 = float(bad.sum()), float((~bad).sum())
    best: tuple[float, tuple[str, str, float] | None] = (0.0, None)
    for name, at in cuts.items():
        slot = np.searchsorted(at, x[name], side="left")  # x <= at[k] for slot <= k
        p = np.cumsum(np.bincount(slot[bad], minlength=len(at) + 1))[: len(at)]
        n = np.cumsum(np.bincount(slot[~bad], minlength=len(at) + 1))[: len(at)]
        for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
            g = _gain(pp.astype(float), nn.astype(float), p0, n0)
            if len(g) and g.max() > best[0] + 1e-9:
                best = (float(g.max()), (name, op, float(at[int(g.argmax())])))
    return best


def learn(x: dict[str, np.ndarray], good: np.ndarray, *, max_rules: int = 12, max_conditions: int = 4, least_precision: float = 0.9, cuts_per_feature: int = 128, seed: int = 7) -> DecisionList:
    """Sequential covering: grow a conjunction on two thirds of what is left, prune it on the other third, drop what it covers.

    Stops at the first rule whose precision on the pruning rows is under least_precision.
    """
    bad = ~good.astype(bool)
    if not bad.any() or bad.all():
        return DecisionList()
    left = np.ones(len(bad), bool)
    part = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, cuts_per_feature + 1)[1:-1], method="lower")) for k, v in x.items()}
    rules: list[Rule] = []
    while len(rules) < max_rules and (bad & left).sum() >= 2:
        grow, prune = left & part, left & ~part
        inside, conditions = grow.copy(), []
        while len(conditions) < max_conditions and bad[inside].any() and not bad[inside].all():
            _, found = _best_condition({k: v[inside] for k, v in x.items()}, bad[inside], cuts)
            if found is None:
                break
            conditions.append(found)
            inside &= Rule((found,)).matches(x)
        if not conditions:
            break

        def worth(cs: list, prune: np.ndarray = prune) -> tuple[float, int]:
            hit = Rule(tuple(cs)).matches(x) & prune
            p, n = int((bad & hit).sum()), int((~bad & hit).sum())
            return ((p - n) / (p + n) if p + n else -1.0, p + n)

        value, _ = worth(conditions)
        while len(conditions) > 1:  # drop the last condition as long as this doesn't hurt on the pruning rows
            shorter, _ = worth(conditions[:-1])
            if shorter < value:
                break
            conditions, value = conditions[:-1], shorter
        hit = Rule(tuple(conditions)).matches(x)
        p, n = int((bad & hit & left).sum()), int((~bad & hit & left).sum())
        if (p + 1) / (p + n + 2) < least_precision or value < 2 * least_precision - 1:
            break
        rules.append(Rule(tuple(conditions), p + n, p / (p + n)))
        left &= ~hit
    return DecisionList(tuple(rules))


def fit(documents: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learn from at most sample_rows labelled rows; what comes to the driver is bounded by that parameter."""
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("__quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = (
        documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .withColumn("__stats", text_stats(F.col("text")))
        .select("__quality", *[c.alias(k) for k, c in ratio_columns(lambda c: F.col(f"__stats.{c}")).items()],
                base_failed(F.col("__stats.n_words"), F.col("__stats.n_repeat_words")).alias("__failed"))
        .where("not __failed").limit(4 * sample_rows).toPandas()
    )
    rows = rows.sort_values(list(rows.columns), ignore_index=True)
    return learn({c: rows[c].to_numpy(float) for c in rows.columns if not c.startswith("__")}, rows["__quality"].to_numpy() == 1)


def judge(documents: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents with their statistics, base_failed, the deciding rule's number and kept."""
    out = documents.withColumn("__stats", text_stats(F.col("text")))
    features = ratio_columns(lambda c: F.col(f"__stats.{c}"))
    failed = base_failed(F.col("__stats.n_words"), F.col("__stats.n_repeat_words"))
    return out.withColumns(
        {c: F.col(f"__stats.{c}") for c in STATS}
        | {"base_failed": failed, "rule": rules.rule_number(features), "kept": ~failed & rules.verdict(features)}
    ).drop("__stats")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = fit(documents, table(spark, sf_dir, "labels"))
    return judge(documents.select("doc_id", "text"), rules).select("doc_id", *BASE, "base_failed", "kept", "rule")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, learned from the labels of what the stage gets. Odd rows as in the module; the columns are those of docs."""
    rules = fit(docs, table(spark, sf_dir, "labels"))
    measured = docs.withColumn("__stats", text_stats(F.col("text")))
    features = ratio_columns(lambda c: F.col(f"__stats.{c}"))
    failed = base_failed(F.col("__stats.n_words"), F.col("__stats.n_repeat_words"))
    return measured.where(~failed & rules.verdict(features)).select(*docs.columns)
