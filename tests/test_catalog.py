"""Every query with SQL gives the same rows in Spark and in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from brinewave.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(values):
    return sorted(tuple(repr(float(v) + 0.0) if isinstance(v, float) else repr(v) for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    expected = duck.sql(catalog.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(expected.columns)
    assert rows(tuple(r) for r in df.select(*cols).collect()) == rows(expected.select(*[f'"{c}"' for c in cols]).fetchall())


@pytest.mark.parametrize("name", ["q21_cov_eig", "q22_pca", "q33_ward", "q61_math_summary"])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


@pytest.fixture(scope="module")
def recordings():
    """record -> (channels C0 to C7) x samples of the vectors, as the queries' stretches put them together."""
    import numpy as np
    import pyarrow.parquet as pq

    t = pq.read_table(f"{DATA}/embeddings.parquet").to_pydict()
    out = {}
    for i, v in sorted(zip(t["vec_id"], t["embedding"], strict=True)):
        out.setdefault(i % 10, []).append(np.asarray(v, float).reshape(8, 8))
    return {k: np.concatenate(x, axis=1) for k, x in out.items()}


def test_components_of_whole_recordings(spark, recordings):
    """What holds of q56 and q58 whatever the sources of noise are; test_stretches holds sums over frames against the kernel."""
    import numpy as np

    shares, power = {}, {}
    for r in catalog.QUERIES["q56_ica"](spark, DATA).collect():
        shares.setdefault(r.record_id, []).append((r.component, r.share, r.channel_share))
    for r in catalog.QUERIES["q58_artefact_removal"](spark, DATA).collect():
        power.setdefault(r.record_id, []).append(r)
    for k, x in recordings.items():
        own = sorted(shares[k])
        assert [c for c, _, _ in own] == list(range(7)) and np.allclose([s for _, s, _ in own], 1 / 7, atol=1e-5)
        assert abs(sum(c for _, _, c in own) - 1) < 1e-5 and all(a[2] >= b[2] for a, b in zip(own, own[1:], strict=False))
        assert [r.n for r in power[k]] == [x.shape[1]] * 8 and len({r.n_removed for r in power[k]}) == 1 and power[k][0].n_removed <= 3
        if not power[k][0].n_removed:
            assert np.allclose(sorted(r.power for r in power[k]), np.sort((x**2).sum(axis=1)), atol=1e-3)


def test_band_pass_of_whole_recordings(spark, recordings):
    import numpy as np

    from brinewave.operators import signal

    taps = np.array(signal.band_pass_taps(64.0, low=1.0, high=25.0))
    for r in catalog.QUERIES["q59_band_pass"](spark, DATA).collect():
        y = signal.filtered(recordings[r.record_id][int(r.channel[1])], taps)
        assert r.n == len(y) and abs(r.rms - np.sqrt((y**2).mean())) < 1e-6
