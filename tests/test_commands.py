from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.__main__ import main
from orbweave.functions import udfs
from orbweave.functions.kernels import triangle
from orbweave.operators import analysis, report, synthesis, weights


def test_from_points_to_coefficients_and_back(spark, tmp_path):
    truth = spark.createDataFrame([(0, n, m, 1.0 / (n + 1), 0.5 if m else 0.0) for n in range(5) for m in range(n + 1)], analysis.COEFFS)
    field = synthesis.synthesise(weights.glq_grid(spark, 12), truth, 4).select("lon", "lat", "value").toPandas()
    field.to_csv(tmp_path / "p.csv", index=False)
    assert main(["weights", str(tmp_path / "p.csv"), "--out", str(tmp_path / "w")]) == 0
    assert main(["analyze", str(tmp_path / "p.csv"), "--nmax", "4", "--rule", "grid", "--method", "wlsq", "--out", str(tmp_path / "a")]) == 0
    got = spark.read.parquet(str(tmp_path / "a/coeffs")).toPandas().set_index(["n", "m"]).sort_index()
    want = truth.toPandas().set_index(["n", "m"]).sort_index()
    assert np.abs(got[["c", "s"]] - want[["c", "s"]]).to_numpy().max() < 1e-9
    assert main(["synth", str(tmp_path / "a/coeffs"), "--step", "30", "--out", str(tmp_path / "s")]) == 0
    assert spark.read.parquet(str(tmp_path / "s")).count() == 7 * 12
    assert main(["synth", str(tmp_path / "a/coeffs"), "--target-unit", "ewh", "--out", str(tmp_path / "x")]) == 2
    assert main(["roundtrip", "--nmax", "3", "--npoints", "400"]) == 0
    assert main(["nmax", str(tmp_path / "a/coeffs"), "--npoints", "500"]) == 0


def test_series_and_exits(spark, tmp_path, capsys, monkeypatch):
    """A wide table of a full grid with a gap in one month, with all options at their defaults and then with others."""
    cells = [(lat, lon) for lat in range(-85, 90, 10) for lon in range(0, 360, 10)]
    lines = ["lon,lat,2002-01,2002-02,2002-03"] + [f"{lon},{lat},{2 + lat / 90},{'' if (lat, lon) == (5, 40) else 3.0},1.0" for lat, lon in cells]
    (tmp_path / "s.csv").write_text("\n".join(lines))
    assert main(["analyze-series", str(tmp_path / "s.csv"), "--nmax", "2", "--out", str(tmp_path / "a"), "--report-fit"]) == 0
    assert "fft" in capsys.readouterr().out
    c00 = {r["epoch_id"]: r["c"] for r in spark.read.parquet(str(tmp_path / "a/coeffs")).where("n = 0").collect()}
    assert c00[2] == pytest.approx(1.0, abs=2e-3) and c00[1] == pytest.approx(3.0, abs=2e-2) and c00[0] == pytest.approx(2.0, abs=1e-2)
    assert spark.read.csv(str(tmp_path / "a/epochs"), header=True).count() == 3
    assert main(["analyze-series", str(tmp_path / "s.csv"), "--nmax", "2", "--rule", "grid", "--epochs", "1:2", "--method", "wlsq", "--field-unit", "ewh", "--out", str(tmp_path / "b")]) == 0
    assert {r["epoch_id"] for r in spark.read.parquet(str(tmp_path / "b/coeffs")).collect()} == {1}
    assert main(["analyze-series", str(tmp_path / "s.csv"), "--nmax", "2", "--epoch-chunk", "2", "--out", str(tmp_path / "k"), "--report-fit"]) == 0
    rows = lambda x: sorted(map(tuple, spark.read.parquet(str(tmp_path / x / "coeffs")).collect()))
    assert np.allclose(rows("a"), rows("k"), atol=1e-12) and spark.read.csv(str(tmp_path / "k/epochs"), header=True).count() == 3
    assert main(["analyze-series", str(tmp_path / "s.csv"), "--epoch-chunk", "-1", "--out", str(tmp_path / "l")]) == 2
    capsys.readouterr()
    one = "\n".join(["lon,lat,value,err"] + [f"{lon},{lat},{2 + lat / 90},0.5" for lat, lon in cells])
    (tmp_path / "p.csv").write_text(one)
    (tmp_path / "w.csv").write_text("\n".join(["lon,lat,w"] + [f"{lon},{lat},0.5" for lat, lon in cells]))
    assert main(["analyze", str(tmp_path / "p.csv"), "--nmax", "2", "--rule", "uniform", "--out", str(tmp_path / "c")]) == 0
    assert "| method | wlsq |" in capsys.readouterr().out
    assert main(["analyze", str(tmp_path / "p.csv"), "--nmax", "2", "--rule", "user", "--weights", str(tmp_path / "w.csv"), "--sigma-col", "err", "--method", "wlsq", "--out", str(tmp_path / "d")]) == 0
    assert "warning" not in capsys.readouterr().err
    (tmp_path / "tidy.csv").write_text("\n".join(["lon,lat,value"] + [f"{lon},{lat},{t}" for t in range(3) for lat, lon in cells]))
    assert main(["weights", str(tmp_path / "tidy.csv"), "--rule", "uniform", "--out", str(tmp_path / "t")]) == 0
    assert "repeat the coordinates" in capsys.readouterr().err
    np.save(tmp_path / "m.npy", np.stack([np.eye(3), np.zeros((3, 3))]))
    assert main(["nmax", str(tmp_path / "m.npy"), "--npoints", "648"]) == 0
    capsys.readouterr()
    assert main(["nmax", str(tmp_path / "c/coeffs"), "--npoints", "648", "--coverage", "0.5"]) == 0
    assert "allow degree" in capsys.readouterr().out
    assert main(["analyze", str(tmp_path / "none.csv"), "--out", str(tmp_path / "e")]) == 2
    assert main(["analyze", str(tmp_path / "p.csv"), "--rule", "hexagons", "--out", str(tmp_path / "e")]) == 2
    assert main(["analyze", str(tmp_path / "p.csv"), "--rule", "user", "--out", str(tmp_path / "e")]) == 2

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr("orbweave.__main__.points_of", stop)
    assert main(["weights", str(tmp_path / "p.csv"), "--out", str(tmp_path / "e")]) == 130


def test_sql_functions(spark):
    udfs.register(spark)
    row = spark.sql("SELECT sh_legendre(30.0D, 3) AS p").first()["p"]
    p = triangle(np.array([30.0]), 3)[0]
    assert np.allclose(row, [p[n, m] for m in range(4) for n in range(m, 4)])
    rows = spark.sql("SELECT * FROM sh_basis(30.0D, 40.0D, 2)").collect()
    assert len(rows) == 6 and rows[0]["c"] == 1.0


def test_report(spark):
    cells = spark.range(18 * 36).select(F.col("id").alias("point_id"), (F.floor(F.col("id") / 36) * 10.0 - 85.0).alias("lat"), (F.col("id") % 36 * 10.0).alias("lon"), F.lit(2.0).alias("value"))
    w = weights.grid(cells)
    row = report.report_row(w, analysis.quadrature(w, 2), 2, "quadrature", "grid")
    assert row["c00"] == pytest.approx(2.0) and row["coverage"] == pytest.approx(1.0) and row["warnings"] == []
