import random

import pytest
from pyspark.sql import functions as F

from brinewave.operators import detect, models, segment
from brinewave.operators.asof import as_of


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("length", [1.0, 37.0, 1e6])
def test_as_of_by_hand(spark, forward, length):
    """Hot and empty keys, equal times, values over several borders of segments, nulls, clashing names."""
    rng = random.Random(1)
    left = [(rng.choice("aaab"), k, round(rng.uniform(-50, 300), 1), "old") for k in range(150)] + [("z", 900, 5.0, "old"), ("a", 901, None, "old"), (None, 902, 5.0, "old")]
    right = [(rng.choice("aaaabc"), float(rng.randrange(-30, 260)), rng.randrange(9)) for _ in range(90)] + [("a", None, 7)]
    left += [("a", 1000 + k, t, "old") for k, (_, t, _) in enumerate(right[:20])]
    df = spark.createDataFrame(left, "record_id string, id int, t double, w string")
    got = as_of(df, spark.createDataFrame(right, "record_id string, at double, w int"), by=["record_id"], left_time="t", right_time="at", values=["at", "w"], forward=forward, segment=length)
    assert got.columns == ["record_id", "id", "t", "at", "w"]
    rows = {r.id: (r.at, r.w) for r in got.collect()}
    assert len(rows) == len(left)
    for k, i, t, _ in left:
        fits = [(at, w) for key, at, w in right if key == k and t is not None and at is not None and (at >= t if forward else at <= t)]
        assert rows[i] == ((min if forward else max)(fits) if fits else (None, None)), (k, t)


def test_many_intervals_as_few(spark):
    """Windows and intervals that touch, share bins, lie in each other and far from each other; recordings without intervals."""
    rng = random.Random(2)
    windows = [(r, k, float(a), float(a + rng.choice((1, 30, 200)))) for r in range(4) for k, a in enumerate(rng.randrange(0, 900) for _ in range(60))]
    intervals = [(r, float(a), float(a + rng.choice((0, 1, 17, 400)))) for r in range(3) for a in (rng.randrange(0, 1000) for _ in range((3, 40, 1)[r]))]
    w = spark.createDataFrame(windows, "record_id int, window_id int, t0 double, t1 double")
    i = spark.createDataFrame(intervals, "record_id int, s0 double, s1 double")
    few = sorted(map(tuple, segment.interval_overlap(w, i).collect()))
    assert sorted(map(tuple, segment.interval_overlap_many(w, i, bin_sec=25.0).collect())) == few
    assert sorted(map(tuple, segment.interval_overlap_many(w, i.limit(0)).collect())) == sorted(map(tuple, segment.interval_overlap(w, i.limit(0)).collect()))


def test_latency_of_every_onset(spark):
    i = spark.createDataFrame([(1, 10.0, 20.0), (1, 100.0, 110.0), (1, 500.0, 501.0), (2, 5.0, 6.0)], "record_id int, s0 double, s1 double")
    e = spark.createDataFrame([(1, 7.0), (1, 130.0), (1, 131.0), (3, 1.0)], "record_id int, event_sec double")
    got = {(r.record_id, r.s0): r.latency_sec for r in detect.onset_latencies(i, e, 5.0).collect()}
    assert got == {(1, 10.0): 0.0, (1, 100.0): 30.0, (1, 500.0): None, (2, 5.0): None}


def test_exact_medians(spark):
    """Even and odd numbers, ties, one value, wide ranges, nulls and groups without values."""
    rng = random.Random(3)
    groups = {0: [rng.gauss(0, 1) for _ in range(501)], 1: [rng.gauss(0, 1) for _ in range(500)], 2: [1.0] * 9, 3: [5.0], 4: [-1e300, 1e300, 3.0, 3.0000000000000004], 5: [float(k % 3) for k in range(100)], 6: [2.0**k for k in range(-400, 400)], 7: [None, None]}
    df = spark.createDataFrame([(g, v) for g, x in groups.items() for v in x], "dim int, v double")
    got = {r.dim: r.median for r in models.exact_medians(df).collect()}
    exact = {r.dim: r.m for r in df.groupBy("dim").agg(F.percentile("v", F.lit(0.5)).alias("m")).collect() if r.m is not None}
    assert got == exact
