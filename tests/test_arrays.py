"""npy and npz files against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import analysis
from orbweave.sources import arrays


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", ["npy", "npz", "packed"])
def test_numbers_in_ranges(spark, tmp_path, order, kind):
    x = np.asarray(np.random.default_rng(0).normal(size=(7, 11, 5)).astype(np.float32), order=order)
    path = str(tmp_path / f"a.{'npy' if kind == 'npy' else 'npz'}")
    {"npy": lambda: np.save(path, x), "npz": lambda: np.savez(path, A=x, note="text"), "packed": lambda: np.savez_compressed(path, A=x)}[kind]()
    df = arrays.read_array(spark, f"file://{path}", "" if kind == "npy" else "A", range=100)
    assert df.select(F.spark_partition_id()).distinct().count() == (1 if kind == "packed" else 4)
    back = np.full(x.shape, np.nan)
    for r in df.collect():
        back[r["i0"], r["i1"], r["i2"]] = r["value"]
    assert np.array_equal(back, x)


@pytest.mark.parametrize("kind", ["npy", "npz"])
def test_coefficients_round_trip(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    x = {e: analysis.squared(rng.normal(size=16), 3) for e in (0, 1)}
    c = analysis.to_coeffs(spark, 3, {e: v[analysis.spots(3)] for e, v in x.items()})
    path = f"file://{tmp_path}/c.{kind}"
    arrays.write_coeff_arrays(c, path, 3)
    back = arrays.read_coeff_arrays(spark, path, range=10)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, c.collect()))


def test_what_is_no_matrix(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((3, 4)))
    np.savez(tmp_path / "b.npz", C=np.zeros((2, 2)))
    np.save(tmp_path / "t.npy", np.array(["x"]))
    for name in ("a.npy", "b.npz", "t.npy"):
        with pytest.raises(ValueError):
            arrays.read_coeff_arrays(spark, str(tmp_path / name))
    np.save(tmp_path / "e.npy", np.zeros((0, 2)))
    assert arrays.read_array(spark, str(tmp_path / "e.npy")).count() == 0
