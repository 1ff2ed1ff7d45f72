import random

import numpy as np
import pytest

from brinewave.llm import toxicity as T


def maximal(scores):
    """All maximal scoring segments by definition: take the best, shortest and first, then go on left and right of it."""
    if not any(s > 0 for s in scores):
        return []
    n = len(scores)
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(n) for j in range(i + 1, n + 1)))
    i, j = -best[2], -best[2] - best[1]
    return maximal(scores[:i]) + [(best[0], i, j)] + [(s, a + j, b + j) for s, a, b in maximal(scores[j:])]


@pytest.mark.parametrize("seed", range(20))
def test_segments_by_definition(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 7 for _ in range(14)]
    got = T.segments(np.array(scores))
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in maximal(scores)]
    assert np.allclose([s for s, _, _ in got], [s for s, _, _ in maximal(scores)])


def test_beginnings_back_off():
    s = T.Scorer({"=idiot": 5.0, "idio*": 3.0})
    assert s.word("Idiot!") == 5.0 - T.DRIFT and s.word("idiotas") == 3.0 - T.DRIFT and s.word("the") == -T.DRIFT and s.word("...") == -T.DRIFT


def test_odd_rows(spark, docs, texts, empty):
    m = T.Model({"=alpha": 4.0}, 1.0, 0.01, (-4.0, 2.0, 1.0))
    got = T.score(docs, m, spans=True)
    assert got.count() == len(texts) and set(docs.columns) <= set(got.columns)
    rows = got.select("doc_id", "text", "score", "segments").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        for s in r.segments:
            assert "alpha" in " ".join(r.text.split()[s.start : s.end])
    assert T.score(empty, m).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in T.score(docs, T.fit(docs, none)).collect()} == {0.0}
    assert T.fit(empty, none).weights == {}


def test_learns_words(spark):
    rng = random.Random(1)
    rows = []
    for k in range(600):
        w = [rng.choice("the of and river stone cloud tree sky".split()) for _ in range(40)]
        toxic = k % 4 == 0
        if toxic:
            w[rng.randrange(40)] = "dumbhead"
            w[rng.randrange(40)] = "foulmouth" + rng.choice("abcd")
        rows.append((k, " ".join(w), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = d.select("doc_id", "toxic")
    m = T.fit(d, labels, use=~T.held_out())
    got = T.score(d, m).where(T.held_out()).collect()
    assert np.mean([(r.score >= 0.7) == (r.toxic == 1) for r in got]) > 0.97


def test_tail_and_curve_by_definition():
    rng = np.random.default_rng(3)
    rate, k, n = 0.8, 0.02, rng.integers(20, 400, 20_000).astype(float)
    best = (np.log(k * n) - np.log(-np.log(rng.random(len(n))))) / rate  # P(best <= s) = exp(-k n exp(-rate s))
    found = T.tail_of(best, n)
    assert abs(found[0] / rate - 1) < 0.05 and abs(np.log(found[1] / k)) < 0.2
    m = T.Model({}, rate, k)
    for s in (0.5, 2.0, 7.5, 20.0):
        for words in (1, 50, 20_000):
            assert abs(m.evidence(s, words) + np.log10(-np.expm1(-k * words * np.exp(-rate * s)))) < 1e-6
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [1.5, -0.7] - 0.4)))).astype(float)
    w = T.logistic(x, y, ridge=0.01)
    a = np.column_stack([np.ones(500), x])
    assert np.abs(a.T @ (y - 1 / (1 + np.exp(-a @ w))) - 0.01 * w).max() < 1e-5  # where the penalised likelihood is flat


def test_score_by_hand(spark):
    rng = random.Random(6)
    weights = {"=bad": 4.0, "awfu*": 3.0, "=kind": -2.0}
    m = T.Model(weights, 0.9, 0.05, (-5.0, 1.2, 0.8))
    of = {"bad": 4.0, "Bad!": 4.0, "awfully": 3.0, "kind": -2.0, "tree": 0.0, "sky": 0.0}
    rows = [(k, " ".join(rng.choice(list(of)) for _ in range(rng.randrange(0, 22)))) for k in range(30)] + [(99, None)]
    got = {r.doc_id: r for r in T.score(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    for i, t in rows:
        w = (t or "").split()
        found = [s for s, _, _ in maximal([of[x] - T.DRIFT for x in w])]
        level = lambda s, n=len(w): -np.log10(-np.expm1(-0.05 * n * np.exp(-0.9 * s)))
        evidence, count = (level(max(found)) if found else 0.0), sum(level(s) >= 2 for s in found)
        p = 1 / (1 + np.exp(-(-5.0 + 1.2 * min(evidence, 12) + 0.8 * np.log1p(count))))
        assert abs(got[i].score - p) < 1e-9 and got[i].n_segments == count and abs(got[i].evidence - evidence) < 1e-6
        assert abs(got[i].best_segment - max(found, default=0.0)) < 1e-9
