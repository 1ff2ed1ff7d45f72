import math

import numpy as np
import pandas as pd

from brinewave.operators import forest, models
from brinewave.plans import catalog


def points_of(spark, n=40, seed=0):
    rows = [(k, k % 2, int(x[0] > 0), x.tolist()) for k, x in enumerate(np.random.default_rng(seed).normal(size=(n, 3)))]
    return spark.createDataFrame(rows, "id long, record_id long, y int, features array<double>")


def test_forest_query_has_a_hundred_trees_of_depth_twelve(spark, monkeypatch):
    seen, fit = [], forest.fit
    monkeypatch.setattr(forest, "fit", lambda train, **how: seen.append(how) or fit(train, **{**how, "trees": 2, "depth": 2}))
    points = points_of(spark)
    monkeypatch.setattr(catalog.V, "points", lambda *_: points)
    assert catalog.q30_random_forest(spark, "").first()["n"] == 40
    assert [(how["trees"], how["depth"]) for how in seen] == [(100, 12)] * 2


def test_draws_are_poisson_and_differ_by_tree():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    a, b = forest.draws(keys, 0, 42), forest.draws(keys, 1, 42)
    assert abs(a.mean() - 1) < 0.03 and abs(a.var() - 1) < 0.05 and abs(np.corrcoef(a, b)[0, 1]) < 0.03
    assert abs((a == 0).mean() - math.exp(-1)) < 0.02 and (forest.draws(keys, 0, 42) == a).all()


def test_trees_by_brute_force(spark):
    """Each tree's draw and class weights by hand, and each node's split the best of its features by plain counting."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(150, 1)), 1)  # one feature: every node looks at it
    y = ((x[:, 0] > 0.6) ^ (rng.random(150) < 0.15)).astype(int)
    d = spark.createDataFrame([(k, 0, int(y[k]), x[k].tolist()) for k in range(150)], "id long, record_id long, y int, features array<double>")
    f = forest.fit(d.repartition(3), trees=4, depth=3)
    h = np.array([r.h for r in d.selectExpr("id", "xxhash64(id) h").orderBy("id").collect()])
    bins, weights = f.bins(x)[:, 0], forest.weights_of(f.drawn)
    splits = 0
    for t in range(4):
        n = forest.draws(h, t, 42)
        assert f.drawn[t].tolist() == [n[y == 0].sum(), n[y == 1].sum()]
        assert np.allclose(weights[t], [n.sum() / (2 * n[y == c].sum()) for c in (0, 1)])
        assert abs(f.share[t, 1] - 0.5) < 1e-12  # balanced within the bootstrap
        w = n * weights[t][y]

        def gini(rows, w=w):
            total = w[rows].sum()
            return total - (w[rows & (y == 0)].sum() ** 2 + w[rows & (y == 1)].sum() ** 2) / total if total else 0.0

        def check(node, rows, level, t=t, w=w, n=n):
            nonlocal splits
            assert abs(f.share[t, node] - w[rows & (y == 1)].sum() / w[rows].sum()) < 1e-9
            sides = [(bins <= c) & rows for c in range(forest.BINS)]
            gains = [gini(rows) - gini(s) - gini(rows & ~s) if n[s].sum() and n[rows & ~s].sum() else 0.0 for s in sides]
            if f.feature[t, node] < 0:
                assert level == 3 or max(gains) < 1e-6
                return
            splits += 1
            s = sides[f.cut[t, node]]
            assert max(gains) - gains[f.cut[t, node]] < 1e-6
            check(2 * node, s, level + 1)
            check(2 * node + 1, rows & ~s, level + 1)

        check(1, n > 0, 0)
    assert splits > 8


def test_forest_learns_and_is_the_same_for_any_partitions(spark):
    p = points_of(spark, 300)
    train, test = p.where("id < 200"), p.where("id >= 200")
    one, four = ([tuple(r) for r in models.random_forest(train.repartition(n), test, trees=12, depth=4).orderBy("id").collect()] for n in (1, 4))
    assert one == four and np.mean([r[2] == r[3] for r in one]) > 0.9


def test_forest_of_odd_rows(spark):
    kind = "id long, record_id long, y int, features array<double>"
    none = spark.createDataFrame([], kind)
    odd = spark.createDataFrame([(1, 0, 1, None), (2, 0, 0, [math.nan, 1.0]), (None, None, None, [0.0, None])], kind)
    score = lambda f: {r.id: (r.y_pred, r.y_score) for r in forest.predict(f, odd).collect()}
    assert score(forest.fit(none, trees=3, depth=2)) == {1: (None, None), 2: (0, 0.5), None: (0, 0.5)}
    one_class = spark.createDataFrame([(k, 0, 1, [float(k), 0.0]) for k in range(20)], kind)
    assert score(forest.fit(one_class, trees=3, depth=2))[2] == (1, 1.0)
    rows = [(k, 0, k % 2, [float(k % 2), None]) for k in range(30)] + [(None, 0, 1, [1.0, math.nan])] * 5 + [(77, 0, None, [1.0, 1.0]), (78, 0, 1, None)]
    f = forest.fit(spark.createDataFrame(rows, kind), trees=8, depth=3)
    assert f.drawn.sum() > 0 and set(score(f)) == {1, 2, None}
    assert forest.predict(f, none).count() == 0


def test_forest_counts_rows_together_and_both_ways():
    """Rows of several batches are counted at once; a table of all keys counts as sorting does."""
    rng = np.random.default_rng(0)
    batches = [pd.DataFrame({"h": rng.integers(0, 99, k), "y": rng.integers(0, 2, k), "bins": list(rng.integers(0, 9, (k, 3)).astype(np.int16))}) for k in (4, 0, 5, 7)]
    got = list(forest.held(iter(batches), 8))
    assert [len(h) for h, _, _ in got] == [9, 7] and got[0][2].dtype == np.int16
    assert np.concatenate([h for h, _, _ in got]).tolist() == pd.concat(batches)["h"].tolist()
    key, y, n = rng.integers(0, 40, 300), rng.integers(0, 2, 100), rng.integers(1, 4, 100)
    few, many = forest.counted(key, y, n, 3, 10_000), forest.counted(key, y, n, 3, 40)
    assert all((a == b).all() for a, b in zip(few, many, strict=True)) and few[1].sum() + few[2].sum() == 3 * n.sum()
