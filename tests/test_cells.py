import numpy as np
import pytest

from brinewave.operators import cells, cluster, models

SCHEMA = "id long, record_id long, y int, features array<double>"


def clustered(n, groups, seed=0, spread=0.05):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-5, 5, (groups, 3))[rng.integers(0, groups, n)] + rng.normal(0, spread, (n, 3))
    x[: n // 10] = x[0]  # equal points
    return x, rng.integers(0, 2, n), rng.integers(0, 7, n)


def frame(spark, x, y, record):
    return spark.createDataFrame([(k, int(record[k]), int(y[k]), x[k].tolist()) for k in range(len(x))], SCHEMA)


def plain_votes(x, y, record, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    d[record[:, None] == record[None, :]] = np.inf
    best = np.argsort(d, axis=1, kind="stable")[:, :k]
    return {i: int(y[best[i]][np.isfinite(d[i, best[i]])].sum()) for i in range(len(x))}


@pytest.mark.parametrize("rows", [15, 60, 5_000])
def test_neighbours_as_by_all_distances(spark, rows):
    """Cells of few and many points, a cell in several chunks, ties of equal points, records to leave out."""
    x, y, record = clustered(300, 12)
    got = {r.id: r.votes for r in models.knn(frame(spark, x, y, record), 5, rows=rows).collect()}
    assert got == plain_votes(x, y, record, 5)


def test_neighbours_without_structure_and_with_few_rows(spark):
    rng = np.random.default_rng(1)
    x, y, record = rng.normal(size=(90, 30)), rng.integers(0, 2, 90), rng.integers(0, 3, 90)
    assert {r.id: r.votes for r in models.knn(frame(spark, x, y, record), 5, rows=10).collect()} == plain_votes(x, y, record, 5)
    few = {r.id: (r.votes, r.y_score) for r in models.knn(frame(spark, x[:3], np.array([1, 0, 1]), np.array([0, 0, 1])), 5, rows=1).collect()}
    assert few == {0: (1, 1.0), 1: (1, 1.0), 2: (1, 0.5)}


def test_structure_spares_visits(spark):
    """Of 40 cells, a point visits few when points lie in groups; all meet whom the bounds leave."""
    x, y, record = clustered(800, 40, seed=2)
    p = frame(spark, x, y, record).selectExpr("id", "features as v")
    c = cells.cells_of(p, rows=20)
    assert len(c.pivots) > 15
    met = cells.visits(p, c, radius=0.4, self_join=True)
    all_pairs = 800 * 799 // 2
    groups = [(r.block, r.own) for r in met.select("block", "own").collect()]
    size = {}
    for b, own in groups:
        o, g = size.get(b, (0, 0))
        size[b] = (o + own, g + (not own))
    compared = sum(o * (o - 1) // 2 + o * g for o, g in size.values())
    assert compared < 0.25 * all_pairs
    near = {(a, b) for a in range(800) for b in range(a) if ((x[a] - x[b]) ** 2).sum() <= 0.16}
    rows = met.collect()
    own = {}
    for r in rows:
        own.setdefault(r.block, ([], []))[not r.own].append(r.id)
    meeting = set()
    for mine, guests in own.values():
        meeting |= {(max(a, b), min(a, b)) for a in mine for b in mine + guests if a != b}
    assert near <= meeting


def plain_dbscan(x, eps, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        new = np.array([min(label[j] for j in np.flatnonzero(near[i] & core)) if core[i] else -1 for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    return {i: int(label[i]) if core[i] else min((int(label[j]) for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(x))}


@pytest.mark.parametrize("rows", [20, 3_000])
def test_density_clusters_as_by_all_distances(spark, rows):
    x, y, record = clustered(260, 9, seed=3, spread=0.25)
    x = np.concatenate([x, np.random.default_rng(4).uniform(-6, 6, (40, 3))])
    got = {r.id: r.cluster for r in cluster.dbscan(frame(spark, x, [0] * 300, range(300)), 0.4, 5, rows=rows).collect()}
    assert got == plain_dbscan(x, 0.4, 5) and -1 in got.values()
