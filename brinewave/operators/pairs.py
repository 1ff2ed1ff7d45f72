"""All pairs of vectors in blocks, and what a task does with two blocks.

Rows are dealt to blocks by a hash of their id, and each pair of blocks is one group of one task, so no task holds more
than two blocks. A block has a fixed share of the rows until it has MOST_ROWS, so that up to there every row travels
equally often, however many rows there are. Within a group products of matrices say which pairs matter, with a bound on
their rounding; those are then measured by differences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = 16  # blocks that rows are dealt to while a block has LEAST_ROWS to MOST_ROWS
LEAST_ROWS, MOST_ROWS = 1_000, 40_000
TILE = 512, 2_048  # pairs of rows that are looked at together
EPS = float(np.finfo(float).eps)


def matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in rows]) if len(rows) else np.empty((0, 0))


def vectors(rows: pa.Table, name: str = "v") -> np.ndarray:
    """A column of arrays as a matrix, without an object for each row."""
    return pc.list_flatten(rows[name]).to_numpy().astype(float).reshape(len(rows), -1) if len(rows) else np.empty((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences and a few rows at a time: exact where vectors are close."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for k in range(0, len(a), step):
        out[k : k + step] = np.sqrt(((a[k : k + step, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


def squares(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 20_000) -> np.ndarray:
    """Squared distances of rows i of u and rows j of v, by differences."""
    out = np.empty(len(i))
    for k in range(0, len(i), step):
        out[k : k + step] = ((u[i[k : k + step]] - v[j[k : k + step]]) ** 2).sum(axis=1)
    return out


class Products:
    """Squared distances of rows of u and v by products of matrices; each is wrong by less than the slack of its row of u."""

    def __init__(self, u: np.ndarray, v: np.ndarray, kind: type = float) -> None:
        middle = v.mean(axis=0)
        x, y = u - middle, v - middle
        m, n = (x * x).sum(axis=1), (y * y).sum(axis=1)
        self.a, self.b = np.column_stack([-2 * x, np.ones(len(x)), m]).astype(kind), np.column_stack([y, n, np.ones(len(y))]).astype(kind)
        self.slack = 8 * (u.shape[1] + 8) * float(np.finfo(kind).eps) * (m + n.max())

    @classmethod
    def quick(cls, u: np.ndarray, v: np.ndarray) -> Products:
        """In single precision, if its slack is small against the distances of the nearest rows; else in double."""
        with np.errstate(over="ignore", invalid="ignore"):
            p = cls(u, v, np.float32)
            d = p.a[: TILE[0]] @ p.b[: TILE[1]].T
            near = np.median(np.partition(d, min(1, d.shape[1] - 1), axis=1)[:, min(1, d.shape[1] - 1)])  # the first may be the row itself
        return p if 1e-30 < near and p.slack.max() < min(near / 100, 1e30) else cls(u, v)

    def tiles(self, skip: Callable[[slice, slice], bool] | None = None, tile: tuple[int, int] = TILE) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """(rows of u, rows of v, squared distances) of all pairs but those of tiles to skip."""
        for s in range(0, len(self.a), tile[0]):
            for t in range(0, len(self.b), tile[1]):
                rows, cols = slice(s, min(s + tile[0], len(self.a))), slice(t, min(t + tile[1], len(self.b)))
                if not (skip and skip(rows, cols)):
                    yield rows, cols, self.a[rows] @ self.b[cols].T


def within(u: np.ndarray, v: np.ndarray, radius: float, skip: Callable[[slice, slice], bool] | None = None) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(rows of u, rows of v, whether each two are within radius), tile by tile; what rounding may decide is measured by differences."""
    if not len(u) or not len(v):
        return
    p = Products(u, v)
    for rows, cols, d in p.tiles(skip):
        slack = p.slack[rows, None] + 8 * EPS * radius * radius
        near = d <= radius * radius - slack
        i, j = np.nonzero((d <= radius * radius + slack) & ~near)
        near[i, j] = np.sqrt(squares(u[rows], v[cols], i, j)) <= radius
        yield rows, cols, near


def k_nearest(u: np.ndarray, v: np.ndarray, k: int, mine: np.ndarray, other: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of u, row of v, distance) of the k nearest of v to each of u, by distance and then place in v.

    Pairs with mine of u equal to other of v don't count, and those beyond u's bound needn't be told.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(u) or not len(v):
        return none
    p, found = Products(u, v), []
    limit = np.full(len(u), np.inf) if bound is None else bound.astype(float).copy()
    best, at = none, -1
    for rows, cols, d in p.tiles():
        if rows.start != at:
            found.append(best)
            best, at = none, rows.start
        slack = 2 * p.slack[rows]
        most = limit[rows] ** 2 * (1 + 8 * EPS) + slack
        free = np.flatnonzero(np.isinf(most))
        if len(free):
            x = np.where(mine[rows][free][:, None] == other[cols][None, :], np.inf, d[free])
            most[free] = np.partition(x, min(k, x.shape[1]) - 1, axis=1)[:, min(k, x.shape[1]) - 1] + slack[free]
        i, j = np.nonzero(d <= most[:, None])
        i, j = i + rows.start, j + cols.start
        left = mine[i] != other[j]
        i, j = i[left], j[left]
        if not len(i):
            continue
        i, j, e = (np.concatenate(z) for z in zip(best, (i, j, np.sqrt(squares(u, v, i, j))), strict=True))
        order = np.lexsort((j, e, i))
        i, j, e = i[order], j[order], e[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        last = place == k - 1
        limit[i[last]] = np.minimum(limit[i[last]], e[last])
        best = i[place < k], j[place < k], e[place < k]
    found.append(best)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def merged(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """group with the groups a and b put together, pair by pair; a group is called by its least member."""
    while len(a):
        to = np.arange(len(group))
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to[to] != to).any():
            to = to[to]
        group, a, b = to[group], to[a], to[b]
        a, b = a[a != b], b[a != b]
    return group


def linked(u: np.ndarray, mine: np.ndarray, v: np.ndarray, other: np.ndarray, groups: int, radius: float) -> np.ndarray:
    """The components of groups 0 to groups - 1 by links between rows within radius; mine and other are the groups of rows of u and v. Tiles of one component aren't looked at."""
    group = np.arange(groups)

    def one(rows: slice, cols: slice) -> bool:
        a, b = group[mine[rows]], group[other[cols]]
        return a[0] == b[0] and (a == a[0]).all() and (b == a[0]).all()

    for rows, cols, near in within(u, v, radius, one):
        i, j = np.nonzero(near)
        a, b = group[mine[rows]][i], group[other[cols]][j]
        group = merged(group, a[a != b], b[a != b])
    return group


def rows_for(n: int) -> int:
    """Rows of a block, of n rows in all."""
    return min(MOST_ROWS, max(LEAST_ROWS, -(-n // BLOCKS)))


def half_pairs(rows: DataFrame, fn: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str, *, id: str = "id", size: int | None = None) -> DataFrame:
    """fn(block, other block, whether they are one) of every two blocks of rows, put together. Each two meet once."""
    n = rows.count()
    m = max(1, -(-n // (size or rows_for(n))))
    dealt = rows.withColumn("__own", F.pmod(F.xxhash64(F.col(id)), F.lit(m)).cast("int"))
    a = dealt.withColumn("__i", F.col("__own")).withColumn("__j", F.explode(F.sequence(F.col("__own"), F.lit(m - 1))))
    b = dealt.withColumn("__j", F.col("__own")).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__own"))))

    def of(key: tuple[pa.Scalar, ...], x: pa.Table, y: pa.Table) -> pa.Table:
        return fn(x, y, key[0].as_py() == key[1].as_py())

    return a.groupBy("__i", "__j").cogroup(b.groupBy("__i", "__j")).applyInArrow(of, schema)
