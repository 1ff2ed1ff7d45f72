import random
from itertools import combinations

import numpy as np
import pytest

from brinewave.llm import near_dedup as N

from .conftest import sentence


def sets_of(rows, size):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        out.setdefault(i, []).append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset())
    return out


def brute(rows, size, percent):
    """component of each doc_id, by all pairs."""
    sets = sets_of([r for r in rows if r[0] is not None], size)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in sets}, sets


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_by_all_pairs(docs, texts, size, percent):
    expected, sets = brute(texts, size, percent)
    rows = N.mark(docs, size=size, percent=percent).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id is None:
            assert not r.kept
        else:
            assert r.component_id == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


def test_chains_and_families(spark):
    """Chains whose ends are far apart, and families just under the threshold that no pivot joins."""
    rng = random.Random(2)
    rows, base = [], sentence(rng, 200).split()
    for k in range(12):  # each differs from the next in one more place
        rows.append((500 - k, " ".join(base)))
        base[rng.randrange(200)] = f"new{k}"
        base[rng.randrange(200)] = f"more{k}"
    family = sentence(rng, 100).split()
    for k in range(25):
        own = list(family)
        for j in rng.sample(range(100), 5):
            own[j] = f"f{k}x{j}"
        rows.append((k, " ".join(own)))
    expected, _ = brute(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in N.mark(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()}
    assert got == expected


@pytest.mark.parametrize("percent", [80, 85])
def test_bounds_lose_no_link(spark, monkeypatch, percent):
    """One pivot and no small buckets: drifted copies of two texts of different lengths meet by their bounds alone."""
    monkeypatch.setattr(N, "PIVOTS", 1)
    monkeypatch.setattr(N, "SMALL_BUCKET", 0)
    rng = random.Random(percent)
    rows = []
    for base in (sentence(rng, 90).split(), sentence(rng, 60).split()):
        for _ in range(60):
            own = list(base)
            for j in rng.sample(range(len(own)), rng.randrange(5)):
                own[j] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own[: len(own) - rng.randrange(9)])))
    rows.append((7, rows[80][1]))  # a doc_id with two texts
    expected, _ = brute(rows, 3, percent)
    got = {r.doc_id: r.component_id for r in N.mark(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=percent).collect()}
    assert len(set(expected.values())) > 4 and got == expected


def test_empty_table(empty):
    assert N.mark(empty).count() == 0


def test_limits_of_the_comparison():
    limits = N.least_matches(189, 0.85, 1e-6)
    assert [n for n, _ in limits][-1] == 189 and all(0 < m < n for n, m in limits)
    rng = np.random.default_rng(0)
    for n, m in limits:  # at the threshold hardly any pair is lost
        assert (rng.binomial(n, 0.85, 100_000) < m).mean() < 1e-3


def test_bands_hardly_miss():
    for t in (0.8, 0.85):
        r = N.rows_for(t)
        assert r >= 7 and N.band_miss(t, r) <= N.BAND_MISS and N.band_miss(0.2, r) > 1 - 1e-3


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    x, y = np.unique(a[:800]), np.unique(a[100:])
    s = (N.signature(x, 189) == N.signature(y, 189)).mean()
    assert abs(s - 700 / 900) < 0.12


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in N.components(e).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}


def test_stage_judges_repeated_ids_by_their_texts(spark):
    rng = random.Random(9)
    a, b, c = (sentence(rng, 80) for _ in range(3))
    rows = [(1, a, "x"), (2, b, "x"), (7, a, "x"), (7, c, "x"), (7, c, "x"), (None, b, "x"), (None, sentence(rng, 70), "x"), (8, "", "x"), (8, None, "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    left = N.stage(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted([(1, a), (2, b), (7, c), (0, rows[6][1]), (8, ""), (8, ""), (0, "")])
    assert all(r.kept == "x" for r in left)
