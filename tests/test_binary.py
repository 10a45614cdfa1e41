"""Flat arrays and .npy files in splits, against NumPy."""

import numpy as np
import pytest

from spindrift.sources import binary


def values(df):
    rows = sorted((r.position, r.value) for r in df.collect())
    assert [p for p, _ in rows] == list(range(len(rows)))
    return [v for _, v in rows]


@pytest.mark.parametrize("dtype", ["<u4", "<i8", "<f8", "<f4", "u1", "?", ">i2"])
def test_npy_in_splits(spark, tmp_path, monkeypatch, dtype):
    monkeypatch.setattr(binary, "RECORD", 4096)
    monkeypatch.setattr(binary, "LEAST", 64)
    array = (np.random.default_rng(3).random((60, 64)) * 100).astype(dtype)
    np.save(tmp_path / "a.npy", array)
    path = f"file://{tmp_path}/a.npy"
    found = binary.npy(spark, path, dtype, (60, None), split_bytes=array.nbytes // 3)
    assert found.rdd.getNumPartitions() >= 3
    assert np.array_equal(np.array(values(found)), array.ravel().astype(np.float64 if array.dtype.kind == "f" else np.int64))
    at = {(r.y, r.x): r.value for r in binary.indexed(found, array.shape, "y", "x").collect()}
    assert len(at) == array.size and at[59, 63] == array[59, 63] and at[2, 7] == array[2, 7]


def test_flat(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "LEAST", 64)
    array = np.arange(10_000, dtype="<u4")
    array.tofile(tmp_path / "a.bin")
    path = f"file://{tmp_path}/a.bin"
    found = binary.flat(spark, path, "<u4", split_bytes=9_000)
    assert found.rdd.getNumPartitions() >= 3 and values(found) == array.tolist()
    with pytest.raises(ValueError, match="whole elements"):
        binary.flat(spark, path, "V7")
    (tmp_path / "none.bin").write_bytes(b"")
    assert values(binary.flat(spark, f"file://{tmp_path}/none.bin", "<u4")) == []
    np.arange(10_007, dtype="<u2").tofile(tmp_path / "prime.bin")  # no record length divides it
    assert values(binary.flat(spark, f"file://{tmp_path}/prime.bin", "<u2")) == list(range(10_007))


def test_faults(spark, tmp_path):
    path = f"file://{tmp_path}/a.npy"
    np.save(tmp_path / "a.npy", np.ones((3, 4), "<f4"))
    assert binary.header(spark, path).shape == (3, 4)
    with pytest.raises(TypeError, match="float32, not int32"):
        binary.npy(spark, path, "<i4")
    with pytest.raises(ValueError, match="shape"):
        binary.npy(spark, path, shape=(3, 5))
    with pytest.raises(ValueError, match="shape"):
        binary.npy(spark, path, shape=(12,))
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 4))))
    with pytest.raises(ValueError, match="Fortran"):
        binary.npy(spark, f"file://{tmp_path}/f.npy")
    np.save(tmp_path / "o.npy", np.array(["a", "b"]))
    with pytest.raises(ValueError, match="no numbers"):
        binary.npy(spark, f"file://{tmp_path}/o.npy")
    whole = (tmp_path / "a.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-4])
    with pytest.raises(ValueError, match="bytes, but shape"):
        binary.npy(spark, f"file://{tmp_path}/cut.npy")
    np.save(tmp_path / "empty.npy", np.ones((0, 4)))
    assert values(binary.npy(spark, f"file://{tmp_path}/empty.npy")) == []
    with pytest.raises(Exception):
        binary.npy(spark, f"file://{tmp_path}/missing.npy")
