import numpy as np
import pytest

from brinewave.sources import npy


def saved(tmp_path, **arrays):
    for k, x in arrays.items():
        np.save(tmp_path / f"{k}.npy", x)


def test_read_dtypes_shapes_and_orders(spark, tmp_path):
    rng = np.random.default_rng(0)
    arrays = {
        "f4": rng.normal(size=(7, 3)).astype("<f4"), "f8big": rng.normal(size=(5, 2)).astype(">f8"), "i2": rng.integers(-9, 9, (4, 2, 3)).astype("i2"), "u1": np.arange(6, dtype="u1"),
        "flag": np.array([[True, False]]), "one": np.array(3.5), "none": np.empty((0, 4)), "half": rng.normal(size=(3, 2)).astype("f2"),
        "fortran": np.asfortranarray(rng.normal(size=(6, 4))), "fortran3": np.asfortranarray(rng.normal(size=(5, 3, 2))), "wide": np.arange(9, dtype="i8").reshape(3, 3),
    }
    saved(tmp_path, **arrays)
    for size in ("1000000", "200"):
        rows = npy.read_arrays(spark, str(tmp_path), partitionBytes=size).collect()
        for k, x in arrays.items():
            own = sorted((r for r in rows if r.name == k), key=lambda r: r.row)
            flat = x.reshape(max(1, x.ndim) and (x.shape[0] if x.ndim else 1), -1) if x.size else x
            assert [r.row for r in own] == list(range(len(flat))) and all(r.shape == list(x.shape) and r.reason == "" for r in own)
            assert np.array_equal(np.array([r["values"] for r in own]).reshape(flat.shape), flat.astype(float)), k


def test_broken_files_fail_alone(spark, tmp_path):
    saved(tmp_path, good=np.ones((3, 2)), text=np.array(["a", "bc"]), large=np.array([2**60]))
    whole = (tmp_path / "good.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-9])
    (tmp_path / "noise.npy").write_bytes(b"nothing")
    (tmp_path / "empty.npy").write_bytes(b"")
    (tmp_path / "header.npy").write_bytes(whole[:40])
    got = {r.name: r.reason for r in npy.read_arrays(spark, str(tmp_path)).collect()}
    assert got["good"] == "" and set(got) == {"good", "text", "large", "cut", "noise", "empty", "header"} and all(v for k, v in got.items() if k != "good")
    assert got["cut"].startswith("truncated") and "isn't a number" in got["text"] and "2 ** 53" in got["large"]
    with pytest.raises(Exception, match="npy header"):
        npy.read_arrays(spark, str(tmp_path / "noise.npy"), mode="failfast").collect()


@pytest.mark.parametrize("dtype", ["float64", "float32", "int16", ">i4", "uint8", "bool"])
def test_round_trip(spark, tmp_path, dtype):
    rng = np.random.default_rng(1)
    arrays = {f"a{k}": rng.integers(0, 2, (k + 1, 3)).astype(dtype) for k in range(5)}
    rows = [(k, j, x[j].astype(float).tolist()) for k, x in arrays.items() for j in rng.permutation(len(x)).tolist()]
    npy.write_arrays(spark.createDataFrame(rows, "name string, row long, values array<double>").repartition(7), str(tmp_path / "out"), dtype=dtype)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{k}.npy" for k in arrays)
    for k, x in arrays.items():
        y = np.load(tmp_path / "out" / f"{k}.npy")
        assert y.dtype == np.dtype(dtype) and np.array_equal(x, y)
    back = {(r.name, r.row): r["values"] for r in npy.read_arrays(spark, str(tmp_path / "out")).collect()}
    assert back == {(k, j): v for k, j, v in rows}


def test_modes_and_lost_tasks(spark, tmp_path):
    """A task that fails leaves nothing of its job, and what was there stays; overwrite takes the place of all arrays."""
    out = tmp_path / "out"
    df = lambda rows: spark.createDataFrame(rows, "name string, row long, values array<double>")
    npy.write_arrays(df([("a", 0, [1.0]), ("b", 0, [2.0])]), str(out))
    for bad in ([("c", 0, [1.0]), ("d", 0, [1.0]), ("d", 2, [1.0])], [("c", 0, [1.0]), ("e", 0, [1.0]), ("e", 1, [1.0, 2.0])], [("c", 0, [1.0]), ("x/y", 0, [1.0])]):
        with pytest.raises(Exception):  # noqa: B017
            npy.write_arrays(df(bad), str(out))
        assert sorted(p.name for p in out.iterdir()) == ["a.npy", "b.npy"]
    npy.write_arrays(df([("z", 0, [3.0])]), str(out), mode="overwrite")
    assert [p.name for p in out.iterdir()] == ["z.npy"]


def test_commit_takes_each_name_once(tmp_path):
    """Two tasks with files of one name: nothing is moved."""
    w = npy.NpyWriter({"path": str(tmp_path)}, False)
    row = {"name": "a", "row": 0, "values": [1.0]}
    said = [w.write(iter([row])), w.write(iter([row]))]
    with pytest.raises(ValueError, match="several tasks"):
        w.commit(said)
    assert not list(tmp_path.iterdir())
    again = npy.NpyWriter({"path": str(tmp_path)}, False)
    again.write(iter([row]))  # an attempt that was lost
    again.commit([again.write(iter([row])), None])
    assert [p.name for p in tmp_path.iterdir()] == ["a.npy"]
