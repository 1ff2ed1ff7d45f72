import numpy as np
import pytest

from brinewave.operators import cells, cluster, models, pairs, reduce


def cloud(n, seed, shift=0.0):
    """Rounded points, many of them equal or equally far from each other."""
    return np.random.default_rng(seed).normal(size=(n, 4)).round(1) + shift


def frame(spark, x, y):
    return spark.createDataFrame([(k, k % 7, int(y[k]), x[k].tolist()) for k in range(len(x))], "id long, record_id long, y int, features array<double>")


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_within_as_by_differences(shift):
    u, v = cloud(700, 0, shift), cloud(2_300, 1, shift)
    d = pairs.distances(u, v)
    radius = float(np.sort(d.ravel())[200_000])  # pairs that lie at the radius itself
    got = np.zeros(d.shape, bool)
    for rows, cols, near in pairs.within(u, v, radius):
        got[rows, cols] = near
    assert (got == (d <= radius)).all() and (d == radius).sum() > 1


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_nearest_as_by_differences(shift):
    u, v = cloud(700, 0, shift), cloud(2_300, 1, shift)
    mine, other = np.arange(700) % 5, np.arange(2_300) % 5
    d = pairs.distances(u, v)
    d[mine[:, None] == other[None, :]] = np.inf
    best = np.argsort(d, axis=1, kind="stable")[:, :5]
    for bound in (None, d[np.arange(700), best[:, 4]]):
        i, j, _ = pairs.k_nearest(u, v, 5, mine, other, bound)
        assert (i == np.repeat(np.arange(700), 5)).all() and (j.reshape(700, 5) == best).all()


def test_what_travels_grows_with_the_rows():
    """Chunks, and so the visits of a row, stay as many from LEAST_ROWS to MOST_ROWS of a block; a group's guests are bounded."""
    for n in (20_000, 100_000, 600_000):
        assert -(-n // pairs.rows_for(n)) == pairs.BLOCKS
        found = cells.Cells(np.zeros((pairs.BLOCKS, 1)), np.zeros(pairs.BLOCKS), np.ones(pairs.BLOCKS, np.int64), n)
        assert n / found.parts() <= cells.GUESTS
    assert pairs.rows_for(10**8) == pairs.MOST_ROWS


def test_links_of_components_that_were_not_asked_whole(spark, monkeypatch):
    """Two long chains in many chunks, and one link between them that none of the first few points has."""
    monkeypatch.setattr(cluster, "ASKED", 2)
    x = np.zeros((400, 2))
    x[:200, 0], x[200:, 0] = np.arange(200), np.arange(200)
    x[200:, 1] = 50
    x = np.concatenate([x, np.column_stack([np.full(50, 77.0), np.arange(50)])])
    for points, n in ((x, 1), (x[:430], 2)):
        got = [r.cluster for r in cluster.dbscan(frame(spark, points, np.zeros(len(points))), 1.0, 2, rows=20).orderBy("id").collect()]
        assert len(set(got)) == n and got[0] == 0 and got[200] == (0 if n == 1 else 200)


def test_silhouettes_as_by_differences(spark, monkeypatch):
    monkeypatch.setattr(pairs, "LEAST_ROWS", 50)
    monkeypatch.setattr(pairs, "BLOCKS", 4)
    x, y = cloud(260, 3, 1e5), np.arange(260) % 3
    d = pairs.distances(x, x)
    want = {}
    for k in range(260):
        a = d[k, y == y[k]].sum() / ((y == y[k]).sum() - 1)
        b = min(d[k, y == c].mean() for c in range(3) if c != y[k])
        want[k] = (b - a) / max(a, b)
    got = {r.id: r.silhouette for r in reduce.silhouette(frame(spark, x, y), label="y").collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_neighbours_by_several_parts(spark, monkeypatch):
    monkeypatch.setattr(cells, "GUESTS", 40)
    x, y = cloud(300, 5), np.arange(300) % 2
    d, record = pairs.distances(x, x), np.arange(300) % 7
    d[record[:, None] == record[None, :]] = np.inf
    best = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert {r.id: r.votes for r in models.knn(frame(spark, x, y), 5, rows=60).collect()} == {k: int(y[best[k]].sum()) for k in range(300)}


def test_ward_of_blocks(spark, monkeypatch):
    """Blocks of few clusters; two at each distance, in one block or in two."""
    monkeypatch.setattr(pairs, "LEAST_ROWS", 30)
    x = np.unique(cloud(150, 7, 100.0), axis=0)
    got = [r.cluster for r in cluster.ward(frame(spark, x, np.zeros(len(x))), 2, rows=40).orderBy("id").collect()]
    assert got == cluster.ward_labels(x, 2).tolist()
