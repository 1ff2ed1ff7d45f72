import numpy as np
from pyspark.sql import functions as F

from brinewave.llm import source_mixing as M

from .conftest import words


def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        t = {s: 2.0 * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and t[s] > 2 * sizes[s]}
        if not over:
            return t
        full |= over


def test_targets(spark):
    rng = np.random.default_rng(0)
    for _ in range(5):
        sizes = {s: int(rng.integers(0, 5000)) for s in ["a", "B", "ä", None, "c", "d", "zz"]}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in M.targets(df).collect()}
        expected = targets_by_hand(sizes)
        assert all(abs(got[s] - expected[s]) < 1e-6 * max(1, expected[s]) for s in sizes)


def test_mix(docs, texts):
    rows = M.mix(docs).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        assert r["size"] == len(words(r.text)) and 0 <= r.copies <= 2
        by.setdefault(r.source, []).append(r)
    expected = targets_by_hand({s: sum(r["size"] for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert abs(rs[0].target - expected[s]) < 1e-6 * expected[s]
        assert abs(sum(r.rate * r["size"] for r in rs) - rs[0].target) < 1e-4 * rs[0].target
        assert abs(sum(r.copies * r["size"] for r in rs) - rs[0].target) <= 1.5 * max(r["size"] for r in rs)


def test_reruns_agree_and_parts_make_no_gap(docs, monkeypatch):
    take = lambda: sorted((r.doc_id or -1, r["size"], r.copies) for r in M.mix(docs).collect())
    first = take()
    assert first == take()
    monkeypatch.setattr(M, "ROWS_PER_PART", 2)
    assert first == take()


def test_parts_give_the_same_copies(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, s, "w " * int(n)) for k, (s, n) in enumerate((s, n) for s in "abcdef" for n in [*rng.lognormal(3, 1, 20), *[7] * 30])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    take = lambda: sorted((r.doc_id, r.source, r["size"], r.target, r.copies) for r in M.mix(df).collect())
    whole = take()
    monkeypatch.setattr(M, "ROWS_PER_PART", 3)
    split = take()
    assert [(i, c) for i, *_, c in split] == [(i, c) for i, *_, c in whole]
    for s in "abcdef":
        own = [r for r in split if r[1] == s]
        assert abs(sum(n * c for _, _, n, _, c in own) - own[0][3]) <= 1.5 * max(n for _, _, n, _, _ in own)


def test_newton_meets_the_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(s, int(n), 1 + int(rng.integers(0, 4))) for s in "abc" for n in np.unique(rng.lognormal(5, 1.5, 60).astype(int))]
    cells = spark.createDataFrame(rows, "source string, size long, n long")
    total = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    share = {"a": 0.2, "b": 1.0, "c": 1.9}
    goals = total.withColumn("target", F.col("source_size") * F.when(F.col("source") == "a", 0.2).when(F.col("source") == "b", 1.0).otherwise(1.9))
    for r in M.balance(cells, goals).collect():
        z = np.array([(n, k) for s, n, k in rows if s == r.source], float)
        rate = 2 / (1 + np.exp(-r.multiplier * z[:, 0] / r.unit))
        assert abs((rate * z[:, 0] * z[:, 1]).sum() / r.target - 1) < 1e-6 and (r.multiplier > 0) == (share[r.source] > 1 + 1e-9)


def test_empty(empty):
    assert M.mix(empty).count() == 0
