"""SimHash near-duplicates by vantage-point trees over fingerprints.

A fingerprint has 64 bits: bit b is 1 if it is set in over half of the 64-bit hashes of a text's word shingles, repeats
included. Two fingerprints with at most LIMIT differing bits are linked, and linked documents are one component.

Equal fingerprints are one point. The bits are cut into PARTS parts: two points within LIMIT bits are within LIMIT // PARTS
bits in one part at least, so a tree for each part finds every link. A tree cuts the points by their Hamming distance
to vantage points, which come from a bounded sample; its leaves are shards, and every point is owned by one shard of each
tree. By the triangle inequality a point can only have a neighbour on the other side of a cut if it lies near the
border, so only such points visit the other side as guests. Each shard is one group: within it the same cuts go on in
memory, branches are pruned by the same bounds and where all of a branch is one component already, and what is left is
compared exactly. A shard hands on a spanning forest of its links, never all pairs, and the components follow from star
contraction. No link is lost: the bounds are exact, whatever the sample.

Memory. A task holds one shard (about SHARD_ROWS owned points, and guests by the bounds) of 17 bytes a point, and the
trees, which have no more than MOST_SHARDS leaves each. Points that share a part's bits can't be parted by it and stay in
one shard; there, cuts by all bits with the full radius go on.

Defined cases. A null, empty or blank text has the fingerprint 0, which is linked like any other. With fewer words than
a shingle has, the whole sequence is the one shingle. Very long texts are taken whole. Of rows with equal doc_id each has
its own fingerprint, and any of them links that doc_id. A row without doc_id has the component of the documents with
its fingerprint, else null, and links nothing. Ties: a bit set in exactly half the hashes is 0; fingerprints at exactly
LIMIT bits are linked. An empty table gives no rows. `mark` reads doc_id and text and returns its own columns only, so
extra columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from brinewave.llm.common import give_back, materialize, portions, short_batches, table
from brinewave.llm.near_dedup import components

SEED = 42
LIMIT = 4  # differing bits of a link
PARTS = 3
SAMPLE = 200_000  # points of the sample that places the cuts
SHARD_ROWS = 2_048  # points that a shard is meant to own
MOST_SHARDS = 1 << 14  # shards of a tree
LEAF = 256  # owned points that are compared without further cuts
ALL = np.uint64(2**64 - 1)


# --- fingerprints


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of size words, repeats included; A-Z count as a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII is lower-cased
    if not words:
        return np.empty(0, np.uint64)
    k = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536].astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, size: int = 4) -> Column:
    """The fingerprint of each text, as a long with the same 64 bits."""

    @arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in chain.from_iterable(map(portions, batches)):
            yield pa.array(np.array([simhash(shingle_hashes(x, size)) for x in texts], np.uint64).view(np.int64))
        give_back()

    return of(text)


# --- trees


@dataclass
class Tree:
    """Cuts of one part of the bits: node k sends what is within cut[k] of vantage[k] to near[k], else to far[k]; -1 - s is shard s."""

    mask: int
    radius: int
    first_shard: int
    vantage: np.ndarray
    cut: np.ndarray
    near: np.ndarray
    far: np.ndarray
    shards: int


def distance(points: np.ndarray, vantage: np.uint64, mask: np.uint64 = ALL) -> np.ndarray:
    return np.bitwise_count((points ^ vantage) & mask)


def masks(parts: int = PARTS) -> list[int]:
    """The bits 0 to 63 in parts of nearly equal length."""
    ends = [64 * k // parts for k in range(parts + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def best_cut(d: np.ndarray) -> int | None:
    """The distance up to which points are near, so that both sides are most alike; None where all are at one distance."""
    n = np.cumsum(np.bincount(d, minlength=2))
    inner = np.flatnonzero((n > 0) & (n < len(d)))
    return int(inner[np.abs(n[inner] - len(d) / 2).argmin()]) if len(inner) else None


def grow(sample: np.ndarray, mask: int, radius: int, leaf: float, first_shard: int) -> Tree:
    """A tree of a sample, down to leaf sample points a shard; of a few vantage points that which leaves the fewest at its border is taken."""
    rng, m = np.random.default_rng(SEED), np.uint64(mask)
    vantage, cut, near, far, shards = [], [], [], [], 0
    stack: list[tuple[np.ndarray, int, bool]] = [(sample & m, -1, True)]
    while stack:
        points, parent, is_near = stack.pop()
        best = None
        if len(points) > leaf:
            for v in points[rng.integers(0, len(points), 8)]:
                d = distance(points, v)
                c = best_cut(d)
                if c is not None:
                    uneven = abs(2 * int((d <= c).sum()) - len(d))
                    cost = int(((d > c - radius) & (d <= c + radius)).sum()) + uneven
                    if best is None or cost < best[0]:
                        best = cost, v, c, d
        if best is None:
            child = -1 - shards
            shards += 1
        else:
            _, v, c, d = best
            child = len(vantage)
            vantage.append(v), cut.append(c), near.append(0), far.append(0)
            stack += [(points[d <= c], child, True), (points[d > c], child, False)]
        if parent >= 0:
            (near if is_near else far)[parent] = child
    return Tree(mask, radius, first_shard, np.array(vantage, np.uint64), np.array(cut, np.int64), np.array(near, np.int64), np.array(far, np.int64), shards)


def sides(d: np.ndarray, cut: int, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(at the near side, owned there, at the far side, owned there) as masks of points, from their distances to the vantage point.

    An owned point goes to its own side and, from the far side, visits the near one if it may have a neighbour there. A
    guest visits each side where it may.
    """
    near = d <= cut
    return near & own | (d <= cut + radius) & ~near | near & ~own, near & own, ~near & own | (d > cut - radius) & ~own, ~near & own


def route(points: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of point, shard, whether owned) of every visit of points in a tree."""
    out = []
    stack = [(0 if len(tree.vantage) else -1, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        node, at, own = stack.pop()
        if not len(at):
            continue
        if node < 0:
            out.append((at, np.full(len(at), tree.first_shard - 1 - node, np.int32), own))
            continue
        d = distance(points[at], tree.vantage[node], np.uint64(tree.mask)).astype(np.int64)
        to_near, own_near, to_far, own_far = sides(d, int(tree.cut[node]), own, tree.radius)
        stack += [(int(tree.near[node]), at[to_near], own_near[to_near]), (int(tree.far[node]), at[to_far], own_far[to_far])]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# --- one shard


class Groups:
    """Components of points 0 to n - 1."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def root(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while not np.array_equal(nxt := self.parent[up], up):
            up = nxt
        return up

    def join(self, at: np.ndarray) -> None:
        roots = np.unique(self.root(at))
        self.parent[roots] = roots[0]


def forest(points: np.ndarray, own: np.ndarray, mask: int, radius: int, limit: int = LIMIT) -> np.ndarray:
    """For each point of a shard a point of its component there; links are pairs of an owned point and any other."""
    groups, rng = Groups(len(points)), np.random.default_rng(SEED)
    stack = [(np.flatnonzero(own), np.flatnonzero(~own))]
    while stack:
        mine, guests = stack.pop()
        if not len(mine):
            continue
        roots = groups.root(mine)
        if (roots == roots[0]).all():  # only what isn't of this component yet can still matter
            guests = guests[groups.root(guests) != roots[0]]
            if not len(guests):
                continue
        if len(mine) > LEAF:
            at = np.concatenate([mine, guests])
            v = points[mine[rng.integers(len(mine))]]
            whole = distance(points[at], v).astype(np.int64)
            groups.join(at[whole <= limit])
            d, r = distance(points[at], v, np.uint64(mask)).astype(np.int64), radius
            cut = best_cut(d[: len(mine)])
            if cut is None:  # equal in this part: go on by all bits
                d, r = whole, limit
                cut = best_cut(d[: len(mine)])
            is_own = np.arange(len(at)) < len(mine)
            to_near, own_near, to_far, own_far = sides(d, cut, is_own, r)
            stack += [(at[own_near], at[to_near & ~own_near]), (at[own_far], at[to_far & ~own_far])]
            continue
        at = np.concatenate([mine, guests])
        rows = max(1, 4_000_000 // len(at))
        for k in range(0, len(mine), rows):
            near = np.bitwise_count(points[mine[k : k + rows], None] ^ points[at][None, :]) <= limit
            for i in np.flatnonzero(near.sum(axis=1) > 1):
                groups.join(at[near[i]])
    return groups.root(np.arange(len(points)))


EDGE = "a long, b long"


def shard_links(trees: list[tuple[int, int, int]], limit: int):
    """applyInPandas function of a shard's rows (shard, own, point, node): (a, b) of a spanning forest; trees: first shard, mask, radius."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        _, mask, radius = max(t for t in trees if t[0] <= shard)
        node = pdf["node"].to_numpy()
        to = forest(pdf["point"].to_numpy().view(np.uint64), pdf["own"].to_numpy(), mask, radius, limit)
        moved = to != np.arange(len(to))
        return pd.DataFrame({"a": node[moved], "b": node[to[moved]]})

    return of


# --- whole tables


def links(points: DataFrame, *, limit: int = LIMIT, parts: int = PARTS, sample_rows: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links between nodes, as many as connect every component; points has point (long, each once) and node.

    The sample takes points by a hash of them, sample_rows at most on average; it places the cuts and decides nothing else.
    """
    n = points.count()
    share = max(1, -(-n // sample_rows))
    sample = np.array([r.point for r in points.where(F.pmod(F.xxhash64("point", F.lit(SEED)), F.lit(share)) == 0).select("point").collect()], np.int64).view(np.uint64)
    shards = min(MOST_SHARDS, max(1, -(-n // shard_rows)))
    trees: list[Tree] = []
    for mask in masks(parts):
        trees.append(grow(np.sort(sample), mask, limit // parts, len(sample) / shards, sum(t.shards for t in trees)))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, node = (b.column(c).to_numpy(zero_copy_only=False) for c in ("point", "node"))
            for t in trees:
                at, shard, own = route(p.view(np.uint64), t)
                for k in range(0, len(at), 100_000):
                    i = at[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(shard[k : k + 100_000]), pa.array(own[k : k + 100_000]), pa.array(p[i]), pa.array(node[i])], ["shard", "own", "point", "node"])

    visited = points.select("point", "node").mapInArrow(visits, "shard int, own boolean, point long, node long")
    return visited.groupBy("shard").applyInPandas(shard_links([(t.first_shard, t.mask, t.radius) for t in trees], limit), EDGE)


def mark(documents: DataFrame, *, size: int = 4, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that links reach, of every row."""
    base = materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text"), size).alias("point")), "fingerprints")
    nodes = materialize(base.where("doc_id is not null").groupBy("point").agg(F.min("doc_id").alias("node")), "points")
    part = components(links(nodes, limit=limit))
    label = nodes.join(part, "node", "left").select("point", F.coalesce("component", "node").alias("component_id"))
    out = base.join(label, "point", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
