import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.operators import channels
from brinewave.sources import annotations, edf


def test_edf_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).normal(0, 50, (3, 16 * 150))
    edf.write_edf(str(tmp_path / "rec1.edf"), ["FP1-F7", "T8-P8", "T8-P8"], x, 16)
    spark.dataSource.register(edf.EdfSource)
    df = spark.read.format("edf").load(str(tmp_path))
    assert sorted(r.channel for r in df.select("channel").distinct().collect()) == ["FP1-F7", "T8-P8-0", "T8-P8-1"]
    rows = df.where("channel = 'T8-P8-1'").orderBy("chunk_no").collect()
    y = np.concatenate([r.samples for r in rows])
    assert [r.start_sample for r in rows] == [0, 960, 1920] and rows[0].sfreq == 16.0
    assert np.abs(y - x[2]).max() < 0.01
    one = spark.read.format("edf").option("channels", "FP1-F7").load(str(tmp_path))
    assert {r.channel for r in one.select("channel").distinct().collect()} == {"FP1-F7"}


def test_sidecar_lines(spark):
    lines = spark.createDataFrame([(1, " 12.5   40 x"), (1, "bad 3"), (1, ""), (2, "7"), (2, "1\t2")], "record_id int, value string")
    got = sorted((r.record_id, r.s0, r.s1) for r in annotations.sidecar(lines, keys=["record_id"]).collect())
    assert got == [(1, 12.5, 40.0), (2, 1.0, 2.0)]


def test_summary_blocks(spark):
    text = "Channel 1\n\nFile Name: a_1.edf\nSeizure 1 Start Time: 10 seconds\nSeizure 1 End Time: 20 seconds\nSeizure 2 Start Time: 30 seconds\n\nFile Name: a_10.edf\nSeizure Start Time: 5 seconds\nSeizure End Time: 6 seconds\n"
    files = spark.createDataFrame([("a_1.edf", text), ("a_10.edf", text), ("a_2.edf", text)], "file_name string, content string")
    got = sorted((r.file_name, r.seizure_no, r.s0, r.s1) for r in annotations.summary_intervals(files, keys=["file_name"]).collect())
    assert got == [("a_1.edf", 0, 10.0, 20.0), ("a_10.edf", 0, 5.0, 6.0)]


def test_json_lists_are_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"model": "knn", "n_records": 3}')
    (tmp_path / "b.json").write_text("[1, 2]")
    got = annotations.read_json_objects(spark, str(tmp_path), "model string, n_records long").collect()
    assert [(r.file_name, r.model, r.n_records) for r in got] == [("a.json", "knn", 3)]


def test_discover_patients(spark):
    files = spark.createDataFrame([("knn_p2_loso.json",), ("comparison_p1.json",), ("svm_p1_loso.json",), ("x.json",)], "file_name string")
    assert [r.patient for r in annotations.discover_patients(files, ("knn", "svm")).collect()] == ["p1", "p2"]


def test_csv_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1.5)], "model string, x double, y double")
    annotations.write_csv(df, str(tmp_path / "c"), ["y", "x", "model"])
    text = next((tmp_path / "c").glob("*.csv")).read_text()
    assert text.splitlines()[0] == "y,x,model"
    annotations.write_json(df, str(tmp_path / "j"))
    annotations.write_processed(df.withColumn("patient", F.lit("p1")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_montage_and_quorum(spark):
    rows = [(1, "fp1-f7"), (1, "F7 - T7"), (1, "ECG"), (1, "VNS 1"), (2, "FP1-F7")]
    c = spark.createDataFrame(rows, "record_id int, channel string")
    kept = channels.exclude_auxiliary(c)
    assert kept.count() == 3
    m = {r.record_id: r for r in channels.select_montage(kept).collect()}
    assert m[1].retained == ["FP1-F7", "F7-T7"] and m[1].missing_n == 16 and m[2].retained_n == 1
    assert {r.record_id: r.status for r in channels.quorum(kept, 2).collect()} == {1: "ok", 2: "rejected"}


def test_first_available_and_folders(spark):
    df = spark.createDataFrame([("p2",), ("p1",), (None,)], "patient string")
    assert annotations.first_available(["p9", "p2", "p1"], df) == "p2" and annotations.first_available([], df) == "p1"
    assert annotations.first_available(["p9"], df) is None
    files = spark.createDataFrame([("/x/p2/a.edf",), ("/x/p1/b.edf",), ("/x/p1/c.edf",)], "path string")
    assert annotations.patient_folders(files) == ["p1", "p2"]
    with pytest.raises(ValueError, match="no patient"):
        annotations.patient_folders(files.limit(0))
