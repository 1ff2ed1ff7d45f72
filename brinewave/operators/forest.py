"""Forest with balanced bootstraps: each tree has its own class weights, from the rows that it drew.

A tree draws each row a Poisson(1) number of times, by the hash of the row's id, so draws need no table and come out the
same on a second attempt. All trees grow level by level together. In a pass each task routes its rows and counts them by
(tree, node, feature, bin, class); Spark adds the counts up and chooses every node's split by windows over bins. Only
splits come to the driver: at most trees * 2^depth rows, whatever the number of training rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewave.operators.pairs import matrix
from brinewave.operators.tables import cut_lineage

BINS = 32
HELD_ROWS = 50_000  # binned rows that a task counts together
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def draws(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: Poisson(1), from a mix of the row's 64-bit key, the tree and the seed."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(1 + tree + (seed << 20))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.searchsorted(POISSON, (z >> np.uint64(11)).astype(float) / 2.0**53, side="right")


@dataclass
class Forest:
    """edges: each feature's cuts; feature, cut, share: by tree and node, where node n has the children 2n and 2n + 1, a leaf
    the feature -1, and share is class 1's of the node's weight; drawn: by tree, the drawn rows of class 0 and 1."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    share: np.ndarray
    drawn: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin of each value: how many of the feature's cuts are below it. What is no number is above all."""
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.int16)

    def nodes(self, bins: np.ndarray, tree: int) -> np.ndarray:
        """Where a tree leads the rows, as far as it has grown."""
        node, row = np.ones(len(bins), np.int64), np.arange(len(bins))
        while (inner := self.feature[tree, node] >= 0).any():
            f = np.maximum(self.feature[tree, node], 0)
            node = np.where(inner, 2 * node + (bins[row, f] > self.cut[tree, node]), node)
        return node

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Mean over trees of the leaf's share of class 1."""
        b = self.bins(x)
        return np.mean([self.share[t, self.nodes(b, t)] for t in range(len(self.feature))], axis=0)


def weights_of(drawn: np.ndarray) -> np.ndarray:
    """By tree, the weight of class 0 and 1: n / (2 * n of the class), of the tree's own draw; 0 for a class it didn't draw."""
    return np.where(drawn > 0, drawn.sum(axis=1, keepdims=True) / (2.0 * np.maximum(drawn, 1)), 0.0)


def feature_edges(train: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Each dimension's distinct quantiles, by approximate percentiles with partial aggregation."""
    x = train.select(F.posexplode("features").alias("dim", "v")).where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    q = x.groupBy("dim").agg(F.percentile_approx(F.col("v").cast("double"), [k / bins for k in range(1, bins)], 10_000).alias("q")).collect()
    found = {r["dim"]: np.unique(r.q) for r in q}
    width = train.agg(F.max(F.size("features"))).first()[0] or 0
    return [found.get(d, np.zeros(0)) for d in range(width)]


def best_splits(counts: DataFrame, weights: np.ndarray, *, tries: int, nodes: int, bins: int) -> DataFrame:
    """(node, j, bin, l0, l1, r0, r1): of each node the split with the least weighted Gini impurity, if it lowers it.

    counts: (key, c0, c1), key = (node * tries + j) * bins + bin, where node = tree * nodes + place in its level. Of equal
    splits, the first j and bin.
    """
    node = F.floor(F.col("key") / (tries * bins)).cast("long")
    c = counts.groupBy("key").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    c = c.select(node.alias("node"), (F.floor(F.col("key") / bins) % tries).cast("int").alias("j"), (F.col("key") % bins).cast("int").alias("bin"), "c0", "c1")
    whole = Window.partitionBy("node", "j")
    run = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"l{k}": F.sum(f"c{k}").over(run) for k in (0, 1)} | {f"r{k}": F.sum(f"c{k}").over(whole) for k in (0, 1)}
    c = c.withColumns(sums).withColumns({f"r{k}": F.col(f"r{k}") - F.col(f"l{k}") for k in (0, 1)}).where("r0 + r1 > 0")
    of = [F.get(F.array(*map(F.lit, weights[:, k].tolist())), F.floor(F.col("node") / nodes).cast("int")) for k in (0, 1)]

    def purity(a: str, b: str):
        x, y = F.col(a) * of[0], F.col(b) * of[1]
        return (x * x + y * y) / (x + y)

    both = (F.col("l0") + F.col("r0")) * of[0], (F.col("l1") + F.col("r1")) * of[1]
    gain = purity("l0", "l1") + purity("r0", "r1") - (both[0] * both[0] + both[1] * both[1]) / (both[0] + both[1])
    c = c.withColumn("gain", F.round(gain, 9)).where("gain > 0")
    best = F.max_by(F.struct("j", "bin", "l0", "l1", "r0", "r1"), F.struct("gain", -F.col("j"), -F.col("bin")))
    return c.groupBy("node").agg(best.alias("b")).select("node", "b.*")


def held(batches: Iterator[pd.DataFrame], rows: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(h, y, bins) of all batches, HELD_ROWS or a batch more at most together; bins stay two bytes each."""
    some: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0
    for pdf in batches:
        if len(pdf):
            some.append((pdf["h"].to_numpy(), pdf["y"].to_numpy(), np.stack(pdf["bins"].to_numpy())))
            n += len(pdf)
        if n >= (rows or HELD_ROWS):
            yield tuple(np.concatenate(z) for z in zip(*some, strict=True))
            some, n = [], 0
    if some:
        yield tuple(np.concatenate(z) for z in zip(*some, strict=True))


def counted(key: np.ndarray, y: np.ndarray, n: np.ndarray, tries: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys below size that occur, draws of class 0, of class 1); each row has tries keys, one after the other. Few keys are sorted, many are counted in a table of all."""
    if len(key) * 4 < size:
        names, to = np.unique(key, return_inverse=True)
        c = [np.bincount(to, weights=np.repeat(np.where(y == v, n, 0), tries), minlength=len(names)).astype(np.int64) for v in (0, 1)]
        return names, c[0], c[1]
    c = [np.bincount(key, weights=np.repeat(np.where(y == v, n, 0), tries), minlength=size) for v in (0, 1)]
    names = np.flatnonzero(c[0] + c[1])
    return names, c[0][names].astype(np.int64), c[1][names].astype(np.int64)


def fit(train: DataFrame, *, trees: int = 100, depth: int = 12, seed: int = 42, bins: int = BINS) -> Forest:
    """A forest of (id, y, features); y is 0 or 1, and each node looks at the square root of the number of features.

    Rows without a label or features don't train; rows of one id are drawn together. Without rows every share is 0.5, and
    with one class each tree is a leaf. Features need no scaling, since only their order counts.
    """
    t = train.where("y is not null and features is not null")
    edges = feature_edges(t, bins)
    size = 2 ** (depth + 1)
    forest = Forest(edges, np.full((trees, size), -1, np.int16), np.zeros((trees, size), np.int16), np.full((trees, size), 0.5), np.zeros((trees, 2), np.int64))
    if not edges:
        return forest
    sc, tries = train.sparkSession.sparkContext, max(1, math.isqrt(len(edges)))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["h"], "y": pdf["y"], "bins": list(forest.bins(matrix(pdf["features"])))})

    rows = t.select(F.xxhash64("id").alias("h"), F.col("y").cast("int").alias("y"), F.col("features").cast("array<double>").alias("features"))
    rows = cut_lineage(rows.mapInPandas(cut_up, "h long, y int, bins array<short>"), "binned")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((trees, 2), np.int64)
        for pdf in batches:
            h, y = pdf["h"].to_numpy(), pdf["y"].to_numpy()
            for k in range(trees):
                n[k] += np.bincount(y, weights=draws(h, k, seed), minlength=2).astype(np.int64)
        yield pd.DataFrame({"tree": np.arange(trees), "n0": n[:, 0], "n1": n[:, 1]})

    for r in rows.select("h", "y").mapInPandas(draw, "tree int, n0 long, n1 long").groupBy("tree").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect():
        forest.drawn[r.tree] = r.n0, r.n1
    weights = weights_of(forest.drawn)
    share = lambda k, a, b: b * weights[k, 1] / (a * weights[k, 0] + b * weights[k, 1])
    has = forest.drawn.sum(axis=1) > 0
    forest.share[has, 1] = [share(k, *forest.drawn[k]) for k in np.flatnonzero(has)]
    open_ = np.zeros((trees, size), bool)
    open_[:, 1] = (forest.drawn > 0).all(axis=1)
    for level in range(depth):
        first = 2**level
        if not open_[:, first : 2 * first].any():
            break
        rng = np.random.default_rng((seed, level))
        looks = np.zeros((trees, first, tries), np.int16)
        at = np.nonzero(open_[:, first : 2 * first])
        looks[at] = np.argsort(rng.random((len(at[0]), len(edges))), axis=1)[:, :tries]
        shared = sc.broadcast((forest, open_, looks))

        def count(batches: Iterator[pd.DataFrame], shared=shared, first=first) -> Iterator[pd.DataFrame]:
            grown, still, look = shared.value
            for h, y, b in held(batches):
                for k in range(trees):
                    n = draws(h, k, seed)
                    drawn = np.flatnonzero(n)
                    node = grown.nodes(b[drawn], k)
                    live = (node >= first) & still[k, node]
                    if not live.any():
                        continue
                    at, place = drawn[live], node[live] - first
                    bin_of = b[at[:, None], look[k, place]].astype(np.int64)
                    key = ((place[:, None] * tries + np.arange(tries)) * bins + bin_of).ravel()
                    key, c0, c1 = counted(key, y[at], n[at], tries, first * tries * bins)
                    yield pd.DataFrame({"key": key + k * first * tries * bins, "c0": c0, "c1": c1})

        for r in best_splits(rows.mapInPandas(count, "key long, c0 long, c1 long"), weights, tries=tries, nodes=first, bins=bins).collect():
            k, place = divmod(r.node, first)
            node = first + place
            forest.feature[k, node], forest.cut[k, node] = looks[k, place, r.j], r.bin
            forest.share[k, 2 * node], forest.share[k, 2 * node + 1] = share(k, r.l0, r.l1), share(k, r.r0, r.r1)
            open_[k, 2 * node], open_[k, 2 * node + 1] = r.l0 > 0 and r.l1 > 0, r.r0 > 0 and r.r1 > 0
        shared.unpersist()
    return forest


def predict(forest: Forest, points: DataFrame) -> DataFrame:
    """(id, record_id, y, y_pred, y_score); null where there are no features."""
    shared = points.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def of(rows: pd.Series) -> pd.Series:
        out, has = pd.Series(np.nan, index=rows.index), rows.notna()
        if has.any():
            out[has] = shared.value.probability(matrix(rows[has])) if shared.value.edges else 0.5
        return out.astype(object).where(has, None)

    scored = points.withColumn("y_score", of(F.col("features").cast("array<double>")))
    return scored.select("id", "record_id", "y", F.when(F.col("y_score").isNotNull(), (F.col("y_score") > 0.5).cast("int")).alias("y_pred"), "y_score")
