import numpy as np
from pyspark.sql import functions as F

from brinewave.functions import arrays
from brinewave.operators import cluster, features, models, reduce, signal


def test_zscore_of_constants(spark):
    s = spark.createDataFrame([(1, "a", 5.0), (1, "a", 5.0), (1, "b", 1.0), (1, "b", 3.0)], "record_id int, channel string, x double")
    assert sorted(r.z for r in signal.zscore(s).collect()) == [-1.0, 0.0, 0.0, 1.0]


def test_fir_is_a_convolution(spark):
    x = np.random.default_rng(0).normal(size=50)
    taps = signal.windowed_sinc(9, 2, 20, 64)
    s = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)], "record_id int, i int, x double")
    got = [r.y for r in signal.fir(s, taps).orderBy("i").collect()]
    assert np.allclose(got, np.convolve(x, taps, "same"))


def test_band_pass_keeps_the_band(spark):
    t = np.arange(256 * 40) / 256  # the filter reaches some 13 seconds, so what is compared lies further from the ends
    inside, outside = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 80 * t)
    y = signal.filtered(inside + outside, np.array(signal.band_pass_taps(256)))
    assert np.abs(y - inside)[3500:-3500].max() < 0.02


def test_resampling_a_sine():
    t = np.arange(1280) / 128
    y = signal.resampled(np.sin(2 * np.pi * 5 * t), 128, 256)
    assert len(y) == 2560 and np.allclose(y, np.sin(2 * np.pi * 5 * np.arange(2560) / 256), atol=1e-9)


def test_ica_takes_a_blink_away():
    rng = np.random.default_rng(1)
    t = np.arange(4000) / 256
    brain = np.stack([np.sin(2 * np.pi * 9 * t), np.sign(np.sin(2 * np.pi * 3 * t)), rng.uniform(-1, 1, len(t)), np.sin(2 * np.pi * 21 * t)])
    blink = np.exp(-(((t % 4) - 2) ** 2) / 0.02) * 20
    names = ["FP1-F7", "F7-T7", "T7-P7", "P7-O1", "FZ-CZ", "CZ-PZ", "C3-P3", "P3-O1"]
    mix = rng.normal(size=(8, 4))
    gain = np.array([1.0, 0.4, 0.1, 0.05, 0.02, 0.01, 0.01, 0.01])
    x = mix @ brain + gain[:, None] * blink + rng.normal(0, 0.01, (8, len(t)))
    y, done = signal.remove_artefacts(x, names, 256.0, eye=2.0)
    assert done["status"] == "ok" and done["removed"]
    assert abs(np.corrcoef(y[0], blink)[0, 1]) < 0.3 * abs(np.corrcoef(x[0], blink)[0, 1])
    s, unmixing, mean = signal.fast_ica(x, 4)
    assert np.allclose(s.std(axis=1), 1, atol=0.02)


def test_ica_needs_two_components():
    x = np.random.default_rng(0).normal(size=(2, 50))
    y, done = signal.remove_artefacts(x, ["FP1-F7", "F7-T7"], 256.0)
    assert done["status"] == "skipped" and (x == y).all()


def test_energies_of_expressions_and_of_the_fft_agree(spark):
    x = np.random.default_rng(2).normal(size=(5, 64))
    e = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "epoch_id int, samples array<double>")
    edges = features.band_edges(8, 1.0, 25.0)
    a = {(r.epoch_id, r.band): r.energy for r in features.band_energy(e, 64, 64.0, edges, keys=["epoch_id"]).collect()}
    for r in e.select("epoch_id", features.band_energy_fft(F.col("samples"), 64.0, edges).alias("v")).collect():
        assert np.allclose(r.v, [a[r.epoch_id, b] for b in range(8)])
    power = np.abs(np.fft.rfft(x, axis=1)) ** 2
    assert np.isclose(a[0, 0], power[0, 1:4].sum())


def test_bands_at_the_usual_rate():
    bins = features.band_bins(512, 256.0, features.band_edges())
    assert [(b[0], b[-1]) for b in bins] == [(1, 7), (8, 13), (14, 19), (20, 25), (26, 31), (32, 37), (38, 43), (44, 49)]


def test_moments_of_constants(spark):
    e = spark.createDataFrame([(1, [2.0, 2.0, 2.0])], "epoch_id int, samples array<double>")
    r = features.basic_stats(e, keys=["epoch_id"]).first()
    assert r["std"] == 0 and r.skew is None and r.kurtosis is None
    h = features.hjorth(e, keys=["epoch_id"]).first()
    assert (h.mobility, h.complexity) == (0.0, 0.0)


def test_differences(spark):
    assert spark.range(1).select(arrays.differences(F.array(*map(F.lit, (1.0, 4.0, 9.0)))).alias("d")).first().d == [3.0, 5.0]


def vectors(spark, x, y=None, record=None):
    n = len(x)
    y, record = y if y is not None else [0] * n, record if record is not None else list(range(n))
    return spark.createDataFrame([(k, int(record[k]), int(y[k]), x[k].tolist()) for k in range(n)], "id long, record_id long, y int, features array<double>")


def test_pca_as_numpy(spark):
    x = np.random.default_rng(3).normal(size=(60, 5)) * [5, 3, 1, 1, 1]
    out, share = reduce.pca(vectors(spark, x), 2)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(share, (values / values.sum())[:2])
    assert abs(np.mean([r.pc1 for r in out.collect()])) < 1e-9


def test_covariance_as_numpy(spark):
    x = np.random.default_rng(4).normal(size=(3, 40))
    rows = [(1, f"c{c}", k, float(x[c, k])) for c in range(3) for k in range(40)]
    s = spark.createDataFrame(rows, "record_id int, channel string, k int, x double")
    names, values, _ = reduce.covariance_eigen(reduce.channel_covariance(s))
    assert names == ["c0", "c1", "c2"] and np.allclose(values, np.sort(np.linalg.eigvalsh(np.cov(x)))[::-1])


def test_blocks_make_no_difference(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(80, 4)), rng.integers(0, 2, 80)
    p = vectors(spark, x, y)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    own, far = y[:, None] == y[None], y[:, None] != y[None]
    a = (d * own).sum(axis=1) / (own.sum(axis=1) - 1)
    b = (d * far).sum(axis=1) / far.sum(axis=1)
    expected = ((b - a) / np.maximum(a, b)).mean()
    assert abs(reduce.silhouette_score(p, label="y").first().silhouette - expected) < 1e-12


def test_dbscan_in_blocks(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(3, 0.1, (30, 2)), [[10.0, 10.0]]])
    got = {r.id: r.cluster for r in cluster.dbscan(vectors(spark, x), 0.5, 4, rows=17).collect()}
    assert {got[k] for k in range(30)} == {0} and {got[k] for k in range(30, 60)} == {30} and got[60] == -1


def test_ward_finds_two_groups():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, (20, 3)), rng.normal(9, 1, (10, 3))])
    assert cluster.ward_labels(x, 2).tolist() == [0] * 20 + [1] * 10


def test_knn_leaves_own_record_out(spark):
    x = np.array([[0.0], [0.1], [0.2], [5.0], [5.1], [5.2]])
    p = vectors(spark, x, [0, 0, 0, 1, 1, 1], [0, 1, 2, 0, 1, 2])
    got = {r.id: r.y_pred for r in models.knn(p, 1).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}


def test_logistic_separates(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(-2, 1, (40, 3)), rng.normal(2, 1, (40, 3))])
    p = vectors(spark, x, [0] * 40 + [1] * 40, [k % 4 for k in range(80)])
    out = models.leave_one_record_out(p, models.logistic).collect()
    assert len(out) == 80 and np.mean([r.y == r.y_pred for r in out]) > 0.95
