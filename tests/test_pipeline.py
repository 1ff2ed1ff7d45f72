import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave import pipeline
from brinewave.config import MONTAGE, Config
from brinewave.operators import signal
from brinewave.sources import edf


def test_from_signal_to_features(spark):
    rng = np.random.default_rng(0)
    rows = [(r, c, rng.normal(0, 20, 64 * 60).tolist()) for r in (1, 2) for c in MONTAGE[:10]] + [(1, "ECG", [0.0] * 3840), (3, MONTAGE[0], [0.0] * 3840)]
    chunks = spark.createDataFrame(rows, "record_id long, channel string, samples array<double>")
    config = Config(target_hz=128.0, margin_sec=4.0)
    clean = pipeline.preprocess(chunks, 64.0, config, ica=False)
    assert clean.count() == 20 and len(clean.first().samples) == 128 * 60
    epochs = pipeline.epoch_rows(clean, 128.0, config)
    assert epochs.count() == 20 * 30
    a = spark.createDataFrame([(1, 20.0, 30.0)], "record_id long, s0 double, s1 double")
    w = pipeline.window_features(epochs, a, 128.0, config)
    n = {(r.record_id, r.label): r["count"] for r in w.groupBy("record_id", "label").count().collect()}
    assert n[2, 0] == 14 and n[1, 1] >= 2
    assert w.select(F.size("features").alias("n")).distinct().first().n == 3 * 8 * 10


def spoil(path, at, value):
    raw = bytearray(path.read_bytes())
    raw[at : at + len(value)] = value
    path.write_bytes(bytes(raw))


def test_recordings_fail_alone_and_are_told_of(spark, tmp_path):
    """Ten files: whole ones at two rates and with an unknown number of records, and six that can't be used, each with its reason."""
    rng = np.random.default_rng(1)
    names = list(MONTAGE[:11])
    signals = {n: rng.normal(0, 30, (11, 64 * 130)) for n in ("a", "b", "unknown")}
    for n, x in signals.items():
        edf.write_edf(str(tmp_path / f"{n}.edf"), names, x, 64)
    spoil(tmp_path / "unknown.edf", 236, b"-1      ")
    edf.write_edf(str(tmp_path / "slow.edf"), names, np.stack([np.sin(np.arange(32 * 90) / 9 + k) * 30 for k in range(11)]), 32)
    edf.write_edf(str(tmp_path / "few.edf"), [*names[:4], "ECG"], rng.normal(0, 30, (5, 64 * 20)), 64)
    edf.write_edf(str(tmp_path / "cut.edf"), names, rng.normal(0, 30, (11, 64 * 20)), 64)
    (tmp_path / "cut.edf").write_bytes((tmp_path / "cut.edf").read_bytes()[:-3000])
    (tmp_path / "noise.edf").write_bytes(rng.bytes(600))
    (tmp_path / "empty.edf").write_bytes(b"")
    edf.write_edf(str(tmp_path / "none.edf"), names, rng.normal(0, 30, (11, 64)), 64)
    spoil(tmp_path / "none.edf", 236, b"0       ")
    (tmp_path / "short.edf").write_bytes((tmp_path / "a.edf").read_bytes()[:700])
    config = Config(target_hz=64.0, low_hz=1.0, high_hz=15.0)
    clean, status = pipeline.preprocess_files(spark, str(tmp_path), config, ica=False)
    got = {r.record_id: r for r in status.collect()}
    assert {k: r.status for k, r in got.items()} == dict(a="ok", b="ok", unknown="ok", slow="ok", few="rejected", cut="failed", noise="failed", empty="failed", none="failed", short="failed")
    assert got["few"].reason.startswith("only 4 of 18 channels; missing: FP1-F3, F3-C3") and len(got["few"].missing) == 14 and got["few"].original_channels == 5 and got["few"].scalp_channels == 4
    assert got["cut"].reason.startswith("truncated: 17 of 20") and got["none"].reason == "no records" and "no EDF header" in got["noise"].reason
    assert got["slow"].rate == 32.0 and got["a"].missing == list(MONTAGE[11:])
    rows = clean.orderBy("record_id", "channel", "start_sample").collect()
    assert {r.record_id for r in rows} == {"a", "b", "unknown", "slow"} and [r.start_sample for r in rows if (r.record_id, r.channel) == ("b", names[3])] == [0, 3840, 7680]
    taps = np.array(signal.band_pass_taps(64.0, low=1.0, high=15.0))
    for n in ("b", "unknown"):
        y = signal.filtered(signals[n][3], taps)
        own = np.concatenate([r.samples for r in rows if (r.record_id, r.channel) == (n, names[3])])
        assert np.abs(own - (y - y.mean()) / y.std()).max() < 0.02
    slow = next(r for r in rows if r.record_id == "slow")
    assert slow.rate == 64.0 and len(slow.samples) == 64 * 90
    said = {r.record_id: r for r in pipeline.provenance(clean, status).collect()}
    assert set(said) == {"a", "b", "unknown", "slow"} and said["slow"].original_rate == 32.0 and said["slow"].duration_sec == 90.0 and set(said["b"].means) == set(names)
    assert said["b"].steps[-1] == "resample 64.0 to 64 Hz" and said["slow"].steps[-1] == "resample 32.0 to 64 Hz" and said["b"].n_samples == 64 * 130


def test_failfast_raises(spark, tmp_path):
    (tmp_path / "noise.edf").write_bytes(b"x" * 600)
    with pytest.raises(Exception, match="no EDF header"):
        pipeline.read_recordings(spark, str(tmp_path), mode="failfast").collect()


def test_a_file_in_many_shares_has_each_chunk_once(spark, tmp_path):
    x = np.random.default_rng(2).normal(0, 30, (2, 64 * 130))
    edf.write_edf(str(tmp_path / "a.edf"), ["FP1-F7", "F7-T7"], x, 64)
    (tmp_path / "noise.edf").write_bytes(b"x" * 6000)
    df = pipeline.read_recordings(spark, str(tmp_path), partitionBytes="3000", recordsPerChunk="7")
    assert df.rdd.getNumPartitions() > 10
    rows = df.where("channel = 'F7-T7'").orderBy("chunk_no").collect()
    assert [r.chunk_no for r in rows] == list(range(19)) and np.abs(np.concatenate([r.samples for r in rows]) - x[1]).max() < 0.01
    assert df.where("status = 'failed'").count() == 1


def test_gaps_fail_alone(spark):
    rows = [("a", "C", 0, 2.0, [1.0, 2.0]), ("a", "C", 2, 2.0, [3.0]), ("b", "C", 0, 2.0, [1.0]), ("b", "C", 2, 2.0, [3.0]), ("d", "C", 0, 2.0, [1.0]), ("d", "D", 0, 4.0, [1.0]), ("e", "C", 0, 2.0, [1.0]), ("e", "D", 0, 2.0, [1.0, 2.0]), ("f", "C", 0, 2.0, [1.0, 2.0]), ("f", "C", 1, 2.0, [1.0])]
    df = spark.createDataFrame([(*r, "ok", "") for r in rows] + [("g", None, None, None, None, "failed", "why")], "record_id string, channel string, start_sample long, sfreq double, samples array<double>, status string, reason string")
    got = {r.record_id: (r.status, r.reason) for r in pipeline.recordings(df, Config(least_channels=1), targets=("C", "D")).collect()}
    lost = "samples are missing or overlap"
    assert got == {"a": ("ok", ""), "b": ("failed", lost), "d": ("failed", "channels have several rates"), "e": ("failed", "channels of unequal lengths"), "f": ("failed", lost), "g": ("failed", "why")}


def test_stretches_to_window_features(spark, tmp_path):
    """Epochs of stretches are those of whole channels."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 30, (10, 64 * 125))
    edf.write_edf(str(tmp_path / "a.edf"), list(MONTAGE[:10]), x, 64)
    config = Config(target_hz=64.0, low_hz=1.0, high_hz=15.0)
    clean, _ = pipeline.preprocess_files(spark, str(tmp_path), config, ica=False)
    clean = clean.persist()
    e = pipeline.epoch_rows(clean, 64.0, config).where(F.col("channel") == MONTAGE[2]).orderBy("epoch_id").collect()
    z = np.concatenate([r.samples for r in clean.where(F.col("channel") == MONTAGE[2]).orderBy("start_sample").collect()])
    assert [r.epoch_id for r in e] == list(range(62)) and np.allclose(np.concatenate([r.samples for r in e]), z[: 62 * 128]) and e[40].start_sec == 80.0


def test_cost_rises_with_the_samples_alone(spark):
    """Sixteen times the samples of a channel take no more than some sixteen times as long."""
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, c, np.sin(np.arange(n)).tolist()) for c in MONTAGE[:10]], "record_id long, channel string, samples array<double>")
        began = time.time()
        pipeline.preprocess(df, 64.0, Config(target_hz=64.0), ica=False).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(2_000)
    assert seconds(32_000) < 16 * max(seconds(2_000), 1.0)
