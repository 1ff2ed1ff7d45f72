"""Neighbours of vectors by Voronoi cells of pivots, exactly.

A bounded sample of the points are pivots; a point's cell is that of its nearest pivot. For a point x of cell p and any y
of cell q, d(x, y) is at least (d(x, q) - d(x, p)) / 2 and at least d(x, q) less the greatest distance in cell q. So a
point only visits the cells that these bounds can't rule out. Cells of more points than meant are dealt to several
chunks, and the visitors of a chunk to several parts, so a group is one chunk with a part of its visitors. Without
structure in the data nearly all points visit nearly all cells, as pairs of blocks do (`visits` tells how many), so there
are few and large cells (`rows_for`); with structure they visit far fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.operators.pairs import distances, matrix, rows_for

MOST_PIVOTS = 4_096
GUESTS = 50_000  # visitors of a group
SLACK = 1e-9


@dataclass
class Cells:
    """Pivots, for each cell its greatest distance to its pivot and its number of chunks, and the number of all points."""

    pivots: np.ndarray
    reach: np.ndarray
    chunks: np.ndarray
    n: int = 0

    def parts(self, groups: int = 64) -> int:
        """Parts that a chunk's visitors are dealt to, if all points visit it: of GUESTS points at most, and enough of them for many tasks."""
        return max(-(-self.n // GUESTS), min(self.n // 2_000, groups // max(1, int(self.chunks.sum()))), 1)

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances to all pivots, cell) of points."""
        d = distances(v, self.pivots)
        return d, d.argmin(axis=1)

    def near(self, d: np.ndarray, cell: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Which cells (columns) may have a point within radius of each point (rows)."""
        own = d[np.arange(len(d)), cell]
        limit = (radius * (1 + SLACK) + SLACK)[:, None]
        return ((d - own[:, None]) / 2 <= limit) & (d - self.reach[None, :] <= limit) & (self.chunks[None, :] > 0)


def cells_of(points: DataFrame, *, rows: int | None = None, most: int = MOST_PIVOTS) -> Cells:
    """Cells of points (id, v), meant to have `rows` points. The pivots are drawn by a hash of the id, `most` at most; which they are changes no result."""
    n = points.count()
    rows = rows or rows_for(n)
    wanted = max(1, min(most, -(-n // rows)))
    drawn = points.select("v", F.xxhash64("id", F.lit("pivot")).alias("h"))
    share = (1 << 63) * min(1.0, 2 * wanted / max(n, 1))
    sample = [r.v for r in drawn.where(F.abs(F.col("h")) <= F.lit(int(min(share, 2**63 - 1)))).orderBy("h").limit(wanted).collect()]
    if not sample:
        sample = [r.v for r in points.orderBy("id").limit(1).collect()]
    pivots = np.unique(matrix(pd.Series(sample)), axis=0) if sample else np.empty((0, 0))
    cells = Cells(pivots, np.zeros(len(pivots)), np.zeros(len(pivots), np.int64), n)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d, cell = cells.place(matrix(pdf["v"]))
                yield pd.DataFrame({"cell": cell, "r": d[np.arange(len(d)), cell]})

    for r in points.select("v").mapInPandas(measured, "cell int, r double").groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r")).collect():
        cells.reach[r.cell], cells.chunks[r.cell] = r.r, -(-r.n // (2 * rows))
    return cells


def visits(points: DataFrame, cells: Cells, *, radius: float | None = None, self_join: bool = False, others: bool = False) -> DataFrame:
    """(cell, chunk, own, and the columns of points) of what meets in a group; points has id, v and, without a fixed radius, radius.

    A point is owned by one chunk of its cell. Otherwise it visits: with a radius all chunks that may have a neighbour, in a
    self join only those that come after its own, so that two points meet once; without one the other chunks of its cell
    alone. others: chunks of its own cell are left out.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    first = np.concatenate([[0], np.cumsum(cells.chunks)])

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 500):
                part = pdf.iloc[k : k + 500]
                d, cell = cells.place(matrix(part["v"]))
                own = first[cell] + pd.util.hash_array(part["id"].to_numpy()).astype(np.uint64) % cells.chunks[cell].astype(np.uint64)
                r = np.full(len(part), radius) if radius is not None else part["radius"].to_numpy(float) if "radius" in part else np.full(len(part), -1.0)
                near = cells.near(d, cell, r)
                near[np.arange(len(part)), cell] = not others
                row, at = np.nonzero(near)
                n = cells.chunks[at]
                block = np.repeat(first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                keep = block > own[row] if self_join else block != own[row]
                row, block = row[keep], block[keep]
                if not others:
                    row, block = np.concatenate([np.arange(len(part)), row]), np.concatenate([own.astype(np.int64), block])
                out = part.iloc[row].reset_index(drop=True)
                out.insert(0, "own", block == own[row])
                out.insert(0, "block", block.astype(np.int64))
                yield out

    return points.mapInPandas(of, f"block long, own boolean, {fields}")


def placed(points: DataFrame, cells: Cells) -> DataFrame:
    """(block, and the columns of points): each point in its own chunk."""
    return visits(points, cells).where("own").drop("own")


def meet(guests: DataFrame, searched: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, *, parts: int) -> DataFrame:
    """fn(part of a chunk's guests, the chunk's searched rows), put together; both have block and id."""
    deal = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    g = guests.withColumn("part", deal).groupBy("block", "part")
    s = searched.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("block", "part")
    return g.cogroup(s).applyInArrow(fn, schema)
