import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.config import Config
from brinewave.operators import components, signal, stretches

SCHEMA = "record_id string, channel string, start_sample long, rate double, total long, samples array<double>"


def cut(x, sizes):
    """(start, samples) of a signal in stretches of the given sizes, over and over."""
    at, k, out = 0, 0, []
    while at < len(x):
        n = sizes[k % len(sizes)]
        out.append((at, x[at : at + n].tolist()))
        at, k = at + n, k + 1
    return out


@pytest.mark.parametrize(("n", "sizes", "tile"), [(5000, [777], 600), (5000, [10, 900, 3], 97), (300, [50], 64), (120, [7], 5), (1, [1], 64), (2, [1], 1), (700, [1000], 10_000)])
def test_filter_of_stretches_is_that_of_the_whole(spark, n, sizes, tile):
    """Halos over several short stretches, channels shorter than the filter, tiles shorter than it: as the whole channel to 1e-9."""
    rng = np.random.default_rng(n)
    x = rng.normal(0, 40, (2, n)) + 7
    taps = np.array(signal.band_pass_taps(64.0, low=2.0, high=20.0))
    rows = [("r", f"c{c}", at, 64.0, n, v) for c in range(2) for at, v in cut(x[c], sizes)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = stretches.band_pass(df, Config(low_hz=2.0, high_hz=20.0), tile=F.lit(tile)).orderBy("channel", "start_sample").collect()
    for c in range(2):
        own = [r for r in got if r.channel == f"c{c}"]
        assert [r.start_sample for r in own] == list(range(0, n, tile)) and max(len(r.samples) for r in own) <= tile
        assert np.abs(np.concatenate([r.samples for r in own]) - signal.filtered(x[c], taps)).max() < 1e-9


def test_a_worker_holds_few_tiles_at_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        rows = [("r", "c", at, 64.0, 24_000, v) for at, v in cut(np.arange(24_000.0), [4000])]
        got = stretches.band_pass(spark.createDataFrame(rows, SCHEMA), tile=F.lit(8), taps=[0.25, 0.5, 0.25]).coalesce(1)
        sizes = [r.n for r in got.mapInPandas(lambda parts: (p.iloc[:1].assign(n=len(p))[["n"]] for p in parts if len(p)), "n long").collect()]
        assert sum(sizes) == 3000 and max(sizes) <= stretches.BATCH_TILES
        spark.conf.set(key, "7")
        stretches.band_pass(spark.createDataFrame(rows, SCHEMA), taps=[1.0])
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)


def test_each_recording_at_its_own_rate(spark):
    rng = np.random.default_rng(0)
    x = {64.0: rng.normal(size=2000), 128.0: rng.normal(size=3000)}
    rows = [(str(r), "c", at, r, len(v), part) for r, v in x.items() for at, part in cut(v, [500])]
    got = stretches.band_pass(spark.createDataFrame(rows, SCHEMA), Config(low_hz=2.0, high_hz=20.0), tile=F.lit(700)).orderBy("start_sample").collect()
    for r, v in x.items():
        y = signal.filtered(v, np.array(signal.band_pass_taps(r, low=2.0, high=20.0)))
        assert np.abs(np.concatenate([g.samples for g in got if g.rate == r]) - y).max() < 1e-9


def test_standardise_by_sums(spark):
    x = np.random.default_rng(1).normal(5, 3, 1000)
    rows = [("r", "c", at, 64.0, 1000, v) for at, v in cut(x, [100, 7])] + [("r", "flat", 0, 64.0, 3, [2.0, 2.0, 2.0]), ("r", "none", 0, 64.0, 0, [])]
    out = stretches.standardise(spark.createDataFrame(rows, SCHEMA)).orderBy("start_sample").collect()
    assert np.allclose(np.concatenate([r.samples for r in out if r.channel == "c"]), (x - x.mean()) / x.std(), atol=1e-9)
    assert next(r for r in out if r.channel == "flat").samples == [0.0, 0.0, 0.0]


def mixture(seed, n=6000):
    rng = np.random.default_rng(seed)
    t = np.arange(n) / 128
    sources = np.stack([np.sin(2 * np.pi * 9 * t), np.sign(np.sin(2 * np.pi * 3 * t)), rng.uniform(-1, 1, n), np.exp(-(((t % 4) - 2) ** 2) / 0.02) * 6])
    return rng.normal(size=(5, 4)) @ sources + rng.normal(0, 0.05, (5, n))


NAMES = ["FP1-F7", "F7-T7", "FZ-CZ", "P7-O1", "T7-P7"]


def rows_of(signals, size=500):
    return [(r, c, at, 128.0, x.shape[1], v) for r, x in signals.items() for c, y in zip(NAMES, x, strict=False) for at, v in cut(y, [size])]


def test_components_by_sums_are_those_of_the_kernel(spark):
    """Two recordings of twelve frames, of which the first guess sees some: the same sources up to sign and order."""
    signals = {"a": mixture(0), "b": mixture(1) * 50 + 3}
    f = components.frames(spark.createDataFrame(rows_of(signals), SCHEMA)).persist()
    got = {r.record_id: r for r in components.unmixing(f, 4, warm_up=3).collect()}
    for name, x in signals.items():
        order = np.argsort(NAMES)
        sources, _, mean = signal.fast_ica(x[order], 4)
        own = np.array(got[name].unmixing).reshape(4, 5) @ (x[order] - np.array(got[name].mean)[:, None])
        assert np.allclose(np.diag(np.corrcoef(own, sources)[:4, 4:]), 1, atol=1e-4)
        assert np.allclose(got[name].mean, mean.ravel()) and np.allclose(own.std(axis=1), 1, atol=1e-3)


def test_cleaning_by_stretches_is_that_of_the_kernel(spark):
    """Removed parts, statuses and what comes back of recordings that can't be cleaned."""
    signals = {"a": mixture(2), "b": mixture(3)}
    few = {"two": mixture(4)[:2]}
    odd = [("odd", c, 0, 128.0, 9, [1.0] * (9 + k)) for k, c in enumerate(NAMES)]
    df = spark.createDataFrame(rows_of(signals, 1024) + rows_of(few, 1024) + odd, SCHEMA)
    rows = components.clean(df, components=4, eye=1.2).collect()
    for name, x in signals.items():
        order = np.argsort(NAMES)
        y, done = signal.remove_artefacts(x[order], [NAMES[k] for k in order], 128.0, components=4, eye=1.2)
        own = [np.concatenate([r.samples for r in sorted((r for r in rows if (r.record_id, r.channel) == (name, NAMES[k])), key=lambda r: r.start_sample)]) for k in order]
        assert {len(r.removed) for r in rows if r.record_id == name} == {len(done["removed"])} and len(done["removed"]) >= 1
        assert np.abs(np.stack(own) - y).max() < 0.02 * np.abs(x).max()
    assert {(r.status, r.reason) for r in rows if r.record_id == "two"} == {("skipped", "fewer than two components")}
    assert np.allclose(next(r for r in rows if r.record_id == "two" and r.start_sample == 0 and r.channel == "F7-T7").samples, few["two"][1][:1024])
    assert {(r.status, r.reason) for r in rows if r.record_id == "odd"} == {("failed", "channels of unequal lengths")}


def test_no_component_is_removed_nothing_changes(spark):
    x = mixture(5)
    rows = components.clean(spark.createDataFrame(rows_of({"a": x}, 2000), SCHEMA), components=4, eye=99.0, muscle=1.1).collect()
    assert all(r.removed == [] and r.status == "ok" for r in rows)
    own = np.concatenate([r.samples for r in sorted((r for r in rows if r.channel == NAMES[1]), key=lambda r: r.start_sample)])
    assert np.allclose(own, x[1])


def test_variance_profile(spark):
    x = mixture(6)
    f = components.frames(spark.createDataFrame(rows_of({"a": x}, 1500), SCHEMA)).persist()
    got = components.variance_profile(f, 4).orderBy("component").collect()
    order = np.argsort(NAMES)
    sources, unmixing, _ = signal.fast_ica(x[order], 4)
    brought = np.sort((np.linalg.pinv(unmixing) ** 2).sum(axis=0) * sources.var(axis=1))[::-1]
    assert np.allclose([r.channel_share for r in got], brought / brought.sum(), atol=1e-3) and np.allclose([r.share for r in got], 0.25, atol=1e-3)
