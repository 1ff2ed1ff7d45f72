import pytest
from pyspark.sql import functions as F

from brinewave.config import Config
from brinewave.operators import features, segment


def windows(spark, seconds):
    """Stacks of a recording of so many seconds, at two-second epochs."""
    e = spark.range(seconds // 2).select(F.lit(1).alias("record_id"), F.col("id").alias("epoch_id"))
    s = segment.stacks(e)
    return s.select("record_id", "window_id", (F.col("first_epoch") * 2.0).alias("t0"), (F.col("first_epoch") * 2.0 + 6).alias("t1"))


@pytest.mark.parametrize(("seconds", "n"), [(3600, 899), (3602, 900), (3611, 902)])
def test_windows_of_a_recording(spark, seconds, n):
    assert windows(spark, seconds).count() == n


@pytest.mark.parametrize(("interval", "ictal", "interictal"), [((2996.0, 3036.0), 10, 873), ((1467.0, 1494.0), 7, 876)])
def test_labels_around_an_interval(spark, interval, ictal, interictal):
    a = spark.createDataFrame([(1, *interval)], "record_id int, s0 double, s1 double")
    k = segment.known(segment.label_windows(windows(spark, 3600), a))
    assert {r.label: r["count"] for r in k.groupBy("label").count().collect()} == {1: ictal, 0: interictal}


def test_without_intervals_all_is_interictal(spark):
    a = spark.createDataFrame([], "record_id int, s0 double, s1 double")
    assert {r.label for r in segment.label_windows(windows(spark, 60), a).collect()} == {0}


def test_the_largest_overlap_counts_and_not_the_sum(spark):
    w = spark.createDataFrame([(1, 0, 0.0, 6.0)], "record_id int, window_id long, t0 double, t1 double")
    a = spark.createDataFrame([(1, 0.0, 2.0), (1, 3.0, 5.0)], "record_id int, s0 double, s1 double")
    assert segment.label_windows(w, a).first().label == -1
    b = spark.createDataFrame([(1, 3.0, 9.0)], "record_id int, s0 double, s1 double")
    assert segment.label_windows(w, b).first().label == 1
    c = spark.createDataFrame([(1, 36.0, 40.0)], "record_id int, s0 double, s1 double")
    assert segment.label_windows(w, c).first().label == 0


def test_step_rounds_half_to_even():
    assert [Config(stack=n).step for n in (1, 2, 3, 5)] == [1, 1, 2, 2]


def test_majority_width(spark):
    w = spark.createDataFrame([(1, 1, 408), (1, 2, 432), (1, 3, 432), (2, 5, 432), (2, 6, 408)], "patient int, record_id int, width int")
    assert {r.patient: r.width for r in features.majority_width(w).collect()} == {1: 432, 2: 432}
    _, gone = features.drop_minority(w)
    assert sorted(r.record_id for r in gone.collect()) == [1, 6]


def test_feature_width(spark):
    for c in (17, 18):
        long_ = spark.range(3 * c * 8).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("value"))
        assert len(features.vectors(long_, ["k"], ["i"]).first().features) == {17: 408, 18: 432}[c]
