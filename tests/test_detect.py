import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from brinewave.operators import detect


def events_by_loop(pred, times, refractory):
    out, last, before = [], -math.inf, 0
    for p, t in zip(pred, times, strict=True):
        if p == 1 and before == 0 and t - last > refractory:
            out.append(t)
            last = t
        before = p
    return out


def frame(spark, pred, times):
    return spark.createDataFrame([(1, k, float(t), int(p)) for k, (p, t) in enumerate(zip(pred, times, strict=True))], "record_id long, event_id long, t_sec double, y_pred int")


def events(spark, pred, times, refractory=30.0):
    return sorted(r.event_sec for r in detect.detect_events(frame(spark, pred, times), refractory).collect())


def test_edges_in_the_refractory_are_lost(spark):
    assert events(spark, [1, 0, 1, 1, 1, 0, 1], [0, 4, 8, 40, 44, 48, 52]) == [0, 52]


def test_the_refractory_is_strict(spark):
    assert events(spark, [1, 0, 1, 0, 1], [0, 10, 30, 40, 61]) == [0, 61]


def test_no_positive(spark):
    assert events(spark, [0, 0], [0, 4]) == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(1, 40)), min_size=1, max_size=60))
def test_as_the_loop(spark, steps):
    times, t = [], 0
    for _, d in steps:
        t += d
        times.append(float(t))
    pred = [p for p, _ in steps]
    found = events(spark, pred, times)
    assert found == events_by_loop(pred, times, 30.0)
    assert all(b - a > 30 for a, b in zip(found, found[1:]))  # noqa: B905


def test_sensitivity_and_latency(spark):
    a = spark.createDataFrame([(1, 100.0, 140.0), (1, 300.0, 310.0), (2, 50.0, 60.0)], "record_id long, s0 double, s1 double")
    e = spark.createDataFrame([(1, 95.0), (1, 900.0)], "record_id long, event_sec double")
    assert {r.record_id: r.sensitivity for r in detect.sensitivity(a, e).collect()} == {1: 1.0, 2: 0.0}
    assert {r.record_id: r.latency_sec for r in detect.latency(a, e).collect()} == {1: 0.0, 2: None}
    assert sorted(r.hit for r in detect.interval_hits(a, e).collect()) == [0, 0, 1]


def test_late_event_has_a_latency_without_sensitivity(spark):
    a = spark.createDataFrame([(1, 100.0, 140.0)], "record_id long, s0 double, s1 double")
    e = spark.createDataFrame([(1, 900.0)], "record_id long, event_sec double")
    assert detect.sensitivity(a, e).first().sensitivity == 0.0
    assert detect.latency(a, e).first().latency_sec == 800.0


def test_one_false_detection_an_hour_is_24_a_day(spark):
    r = spark.createDataFrame([(1, 3600.0), (2, 3600.0), (3, 0.0), (4, 3600.0)], "record_id long, duration_sec double")
    a = spark.createDataFrame([(2, 1.0, 2.0)], "record_id long, s0 double, s1 double")
    e = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 1.0)], "record_id long, event_sec double")
    assert {x.record_id: x.fdr_per_24h for x in detect.false_detections(r, a, e).collect()} == {1: 24.0, 3: 0.0, 4: 0.0}


def test_average_precision_groups_ties(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.9), (1, 1, 0.5), (1, 0, 0.1), (2, 0, 0.3)]
    p = spark.createDataFrame(rows, "record_id long, y_true int, y_score double")
    got = {r.record_id: r.pr_auc for r in detect.average_precision(p, by=["record_id"]).collect()}
    assert abs(got[1] - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-12 and got[2] is None


def test_ranking_of_nulls(spark):
    rows = [("a", 1, 3, 0.5, None, 2.0), ("b", 1, 3, 0.5, 1.0, None), ("c", 1, 3, None, 0.0, 0.0), ("d", 1, 0, 1.0, 0.0, 0.0), ("e", 1, 2, 0.5, 1.0, 4.0)]
    runs = spark.createDataFrame(rows, "model string, patient long, n_records long, sensitivity_mean double, fdr_per_24h_mean double, latency_sec_mean double")
    assert [r.model for r in detect.ranking(runs).orderBy("rank").collect()] == ["e", "b", "a", "c"]


def test_confusion_keeps_empty_cells(spark):
    p = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    assert sorted((r.actual, r.predicted, r.n) for r in detect.confusion(p).collect()) == [(0, 0, 2), (0, 1, 0), (1, 0, 0), (1, 1, 0)]


def test_average_precision_however_scores_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(y), float(s)) for g, y, s in zip(rng.integers(0, 3, 600), rng.random(600) < 0.3, rng.integers(0, 90, 600) / 7, strict=True)] + [(0, 1, None), (1, 0, None)]
    df = spark.createDataFrame(rows, "g int, y_true int, y_score double")
    take = lambda: {r.g: r.pr_auc for r in detect.average_precision(df, by=["g"]).collect()}
    got = take()
    for g in range(3):
        own = [(s, y) for k, y, s in rows if k == g]
        total, tp, n, out = sum(y for _, y in own), 0, 0, 0.0
        for s in sorted({s for s, _ in own}, key=lambda s: (s is None, -(s or 0))):
            here = [y for t, y in own if t == s]
            tp, n = tp + sum(here), n + len(here)
            out += sum(here) * tp / n
        assert abs(got[g] - out / total) < 1e-9
    monkeypatch.setattr(detect, "SCORE_RANGES", 2)
    assert all(abs(take()[g] - got[g]) < 1e-12 for g in got)


def test_results_of_records_sort_nothing_of_the_events_again(spark):
    """Events are used four times; the joined results hold none of their windows, nor those of the precisions."""
    p = spark.createDataFrame([(1, k, float(k), k % 2, k % 3 % 2, float(k)) for k in range(12)], "record_id long, event_id long, t_sec double, y_pred int, y_true int, y_score double")
    a = spark.createDataFrame([(1, 2.0, 5.0)], "record_id long, s0 double, s1 double")
    out = detect.record_results(p, a, p.select("record_id").distinct().selectExpr("record_id", "100.0 as duration_sec"), refractory=2.0, tol=1.0)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString() and out.first().n_events == 3
