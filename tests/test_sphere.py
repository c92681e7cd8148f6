from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbweave.functions import kernels, units
from orbweave.operators import analysis, coeffs, hull, slepian, spectrum, synthesis, weights
from orbweave.plans import planner

FOUR_PI = 4 * np.pi


def random_coeffs(spark, nmax, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(0, n, m, float(rng.normal() / (n + 1)), float(rng.normal() / (n + 1)) if m else 0.0) for n in range(nmax + 1) for m in range(n + 1)]
    return spark.createDataFrame(rows, analysis.COEFFS)


def gap(a, b):
    x = a.toPandas().set_index(["n", "m"]).sort_index()
    y = b.toPandas().set_index(["n", "m"]).sort_index()
    assert len(x) == len(y)
    return float(np.abs(x[["c", "s"]] - y[["c", "s"]]).to_numpy().max())


def test_legendre_closed_forms():
    p = kernels.triangle(np.array([0.0, 90.0, -90.0]), 2)
    assert p[0, 2, 0] == pytest.approx(-np.sqrt(5) / 2, abs=1e-13)
    assert p[1, 2, 0] == pytest.approx(np.sqrt(5), abs=1e-13)
    assert p[0, 1, 1] == pytest.approx(np.sqrt(3), abs=1e-13)
    assert p[0, 2, 2] == pytest.approx(np.sqrt(15) / 2, abs=1e-13)


def test_slopes_against_differences():
    lat = np.array([-60.0, -10.0, 33.0, 70.0])
    h = 1e-5
    ref = -(kernels.triangle(lat + h, 12) - kernels.triangle(lat - h, 12)) / (2 * np.radians(h))
    for m, d in kernels.slopes(lat, 12):
        assert np.abs(d.T - ref[:, m:, m]).max() < 1e-6
    assert [m for m, _ in kernels.slopes(lat, 0)] == [0]


def test_over_sine_at_poles_and_elsewhere():
    p = kernels.triangle(np.array([20.0]), 6)
    for m, q in kernels.over_sine(np.array([20.0, 90.0]), 6):
        assert np.allclose(q[:, 0] * np.cos(np.radians(20.0)), p[0, m:, m])
        assert m == 1 or np.all(q[:, 1] == 0)


def test_glq_recovers_exactly(spark):
    truth = random_coeffs(spark, 12)
    grid = weights.glq_grid(spark, 12)
    assert grid.agg(F.sum("w")).first()[0] == pytest.approx(FOUR_PI)
    field = synthesis.synthesise(grid, truth, 12)
    assert gap(analysis.quadrature(field, 12), truth) < 1e-12
    assert np.abs(analysis.gram(grid, 6) - np.eye(49)).max() < 1e-12


def test_dh_recovers_and_fft_equals_direct(spark):
    truth = random_coeffs(spark, 8, 1)
    for start in (0.0, 0.5, -179.5, 90.3):
        cells = spark.range(18 * 36).select(F.col("id").alias("point_id"), (F.floor(F.col("id") / 36) * 10.0 - 90.0).alias("lat"), (F.col("id") % 36 * 10.0 + start).alias("lon"))
        field = weights.dh(synthesis.synthesise(cells, truth, 8))
        direct = analysis.quadrature(field, 8)
        fast, plan = analysis.quadrature_planned(field, 8, "fft")
        assert plan.path == "fft"
        assert gap(direct, truth) < 1e-8
        assert gap(fast, direct) < 1e-12


def test_fft_refusals(spark):
    cells = spark.range(18 * 36).select((F.floor(F.col("id") / 36) * 10.0 - 90.0).alias("lat"), (F.col("id") % 36 * 10.0).alias("lon"))
    with pytest.raises(ValueError, match="order"):
        planner.plan_longitude(cells, 18, "fft")
    assert planner.plan_longitude(cells, 18).path == "direct"
    assert "full grid" in planner.plan_longitude(cells.where("lat <> 0 or lon <> 0"), 4).reason


def scatter(spark, n=800, seed=2, nmax=4):
    rng = np.random.default_rng(seed)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(0, 360, n)
    return spark.createDataFrame(pd.DataFrame({"point_id": np.arange(n), "lat": lat, "lon": lon}))


def test_least_squares_and_cg_agree(spark):
    truth = random_coeffs(spark, 4, 3)
    field = weights.uniform(synthesis.synthesise(scatter(spark), truth, 4))
    noisy = field.withColumn("value", F.col("value") + F.sin(F.col("point_id") * 1.7) * 0.01)
    assert gap(analysis.least_squares(field, 4)[0], truth) < 1e-10
    a, b = analysis.least_squares(noisy, 4)[0], analysis.conjugate_gradients(noisy, 4)[0]
    assert gap(a, b) < 1e-8


def test_richardson_gains(spark):
    truth = random_coeffs(spark, 3, 4)
    field = weights.voronoi(synthesis.synthesise(scatter(spark, 400), truth, 3))
    one, more = gap(analysis.quadrature(field, 3), truth), gap(analysis.richardson(field, 3, 3), truth)
    assert more < one / 20


def test_hull_areas():
    rng = np.random.default_rng(0)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 300))), rng.uniform(0, 360, 300)
    assert hull.voronoi_areas(lat, lon).sum() == pytest.approx(FOUR_PI)
    assert hull.delaunay_areas(lat, lon).sum() == pytest.approx(FOUR_PI)
    cap = np.degrees(np.arcsin(rng.uniform(0.9, 1, 200)))
    assert hull.voronoi_areas(cap, lon[:200]).sum() == pytest.approx(FOUR_PI)
    assert hull.delaunay_areas(cap, lon[:200]).sum() < 1.0
    with pytest.raises(ValueError, match="coinciding"):
        hull.voronoi_areas(np.append(lat, lat[0]), np.append(lon, lon[0]))


def test_slepian_invariants(spark):
    north = weights.grid(spark.range(18 * 36).select(F.col("id").alias("point_id"), (F.floor(F.col("id") / 36) * 10.0 - 85.0).alias("lat"), (F.col("id") % 36 * 10.0).alias("lon"))).where("lat > 0")
    b = slepian.basis(north, 4)
    assert b.shannon == pytest.approx(25 * 0.5, rel=1e-6)
    assert b.values.max() <= 1 + 2e-2 and b.values.min() >= 0
    assert np.allclose(b.tapers.T @ b.tapers, np.eye(25))


def test_projection_c00_is_the_covered_share(spark):
    cap = weights.grid(spark.range(18 * 36).select(F.col("id").alias("point_id"), (F.floor(F.col("id") / 36) * 10.0 - 85.0).alias("lat"), (F.col("id") % 36 * 10.0).alias("lon"))).where("lat > 0").withColumn("value", F.lit(1.0))
    c00 = analysis.projection(cap, 2).where("n = 0").first()["c"]
    assert c00 == pytest.approx(0.5)
    with pytest.raises(ValueError, match="tau"):
        analysis.projection(cap, 2, 1.5)


def test_horizontal_of_unit_harmonics(spark):
    points = spark.createDataFrame([(lat, lon) for lat in (-90.0, -30.0, 0.0, 45.0, 90.0) for lon in (0.0, 60.0, 200.0)], "lat double, lon double")
    one = spark.createDataFrame([(0, 1, 0, 0.0, 0.0), (0, 1, 1, 1.0, 0.0)], analysis.COEFFS)
    for r in synthesis.horizontal(points, one, 1, scale=False).collect():
        la, lo = np.radians(r["lat"]), np.radians(r["lon"])
        assert r["north"] == pytest.approx(-np.sqrt(3) * np.cos(lo) * np.sin(la), abs=1e-12)
        assert r["east"] == pytest.approx(-np.sqrt(3) * np.sin(lo), abs=1e-12)


def test_units_round_trip_and_refusals(spark):
    x = random_coeffs(spark, 3)
    back = units.convert(units.convert(x, "geopotential", "ewh"), "ewh", "geopotential")
    assert gap(back, x) < 1e-12
    for a, b in (("scalar", "ewh"), ("ewh", "unknown"), ("horizontal_displacement", "geoid"), ("geoid", "metres")):
        with pytest.raises(ValueError):
            units.require_convertible(a, b)
    love = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, -0.3, 0.1, 0.0), (2, -1.0, 0.02, -0.3)], "n int, h double, l double, k double")
    with pytest.raises(ValueError, match="hold"):
        units.require_empty_degrees(x, "radial_displacement", love)


def test_gaussian_methods_agree():
    assert np.allclose(coeffs.gaussian(1000.0, 8), coeffs.gaussian(1000.0, 8, "frc"), atol=1e-6)
    assert np.all(coeffs.gaussian(0.0, 5) == 1)
    assert coeffs.gaussian(300.0, 2)[1] == pytest.approx(0.9984, abs=1e-4)


def test_series_arithmetic(spark):
    a, b = random_coeffs(spark, 3), random_coeffs(spark, 1, 5)
    with pytest.raises(ValueError, match="epochs"):
        coeffs.combine(a, b.withColumn("epoch_id", F.lit(4)))
    assert gap(coeffs.combine(coeffs.combine(a, b), b, -1), a) < 1e-15
    assert gap(coeffs.from_flat(coeffs.flat(a, 3)), a) == 0
    with pytest.raises(Exception, match="degree 3"):
        coeffs.filtered(a, coeffs.degree_table(spark, np.ones(3))).collect()


def test_weight_rules(spark):
    cells = spark.range(18 * 36).select(F.col("id").alias("point_id"), (F.floor(F.col("id") / 36) * 10.0 - 85.0).alias("lat"), (F.col("id") % 36 * 10.0).alias("lon"))
    assert weights.report(weights.weigh(cells)).first()["coverage"] == pytest.approx(1.0, abs=2e-3)
    assert planner.guess_rule(cells) == "dh"
    assert planner.guess_rule(cells.where("lon < 200")) == "grid"
    assert planner.guess_rule(cells.where("lon < 200 and (lat + lon) % 30 < 20")) == "lattice"
    assert planner.guess_rule(scatter(spark)) == "voronoi"
    assert weights.report(weights.weigh(cells.where("lat > 0"), "grid", "global")).first()["total"] == pytest.approx(FOUR_PI)
    with pytest.raises(ValueError):
        weights.weigh(cells, "hexagons")
    with pytest.raises(ValueError, match="even"):
        weights.dh(cells.where("lat > -80"))


def test_warnings():
    found = spectrum.warnings({"coverage": 0.3, "method": "wlsq", "gram_deviation": 0.5, "residual_rms": 1e-9, "data_rms": 1.0, "condition_number": 1e9, "n_points": 10, "nmax": 4})
    assert len(found) == 6
    assert spectrum.warnings({"coverage": 1.0, "n_points": 1000, "nmax": 4}) == []


def test_methods_chosen():
    assert planner.choose_method(1e-4, 1.0, 1000, 100) == "quadrature"
    assert planner.choose_method(0.5, 0.4, 1000, 100) == "projection"
    assert planner.choose_method(0.5, 1.0, 1000, 100) == "wlsq"
    assert planner.choose_method(0.5, 1.0, 10**6, 5000) == "cg"


def cells(spark):
    return spark.range(18 * 36).select(F.col("id").alias("point_id"), (F.floor(F.col("id") / 36) * 10.0 - 85.0).alias("lat"), (F.col("id") % 36 * 10.0).alias("lon"))


def gappy(spark, truth, nmax):
    """Epochs 1, 2 and 5: a third of the points of 1 is not there and some of 2 are null or NaN; 5 has the points of 1."""
    c = synthesis.synthesise(weights.grid(cells(spark)), truth, nmax)
    by = {1: 2.0, 2: 1.0, 5: -3.0}
    parts = [c.withColumn("epoch_id", F.lit(e)).withColumn("value", F.col("value") * k) for e, k in by.items()]
    parts = [p.where("point_id % 3 <> 0") if e != 2 else p.withColumn("value", F.when(F.col("point_id") % 50 == 0, None).when(F.col("point_id") % 50 == 1, float("nan")).otherwise(F.col("value"))) for e, p in zip(by, parts)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]), by


def worst(got, truth, by):
    x = truth.toPandas().set_index(["n", "m"]).sort_index()[["c", "s"]]
    rows = got.toPandas()
    assert set(rows["epoch_id"]) == set(by)
    return max(float(np.abs(g.set_index(["n", "m"]).sort_index()[["c", "s"]] - by[e] * x).to_numpy().max()) for e, g in rows.groupby("epoch_id"))


def test_every_epoch_has_its_own_points(spark, monkeypatch):
    truth = random_coeffs(spark, 3, 6)
    series, by = gappy(spark, truth, 3)
    assert analysis.point_sets(series) == {1: [1, 5], 2: [2]}
    assert worst(analysis.least_squares(series, 3)[0], truth, by) < 1e-10
    assert worst(analysis.conjugate_gradients(series, 3)[0], truth, by) < 1e-8
    assert worst(analysis.projection(series, 3, 1e-6), truth, by) < 1e-8
    assert worst(slepian.analyse(series, 3, 0.01), truth, by) < 1e-8
    monkeypatch.setattr(analysis, "MATRICES", 1)  # a set at a time
    assert worst(analysis.least_squares(series, 3)[0], truth, by) < 1e-10
    monkeypatch.setattr(analysis, "LARGEST", 4)  # no matrix
    assert worst(analysis.conjugate_gradients(series, 3, rtol=1e-8)[0], truth, by) < 1e-6
    assert worst(analysis.least_squares(series, 3)[0], truth, by) < 1e-9
    assert worst(analysis.richardson(series.where("epoch_id = 2"), 3, 60), truth, {2: by[2]}) < 1e-6
    with pytest.raises(ValueError, match="unknowns"):
        analysis.projection(series, 3, 0.5)
    left = analysis.residuals(series, analysis.conjugate_gradients(series, 3, rtol=1e-8)[0], 3).orderBy("epoch_id").collect()
    assert [r["n_points"] for r in left] == [432, 622, 432] and max(r["residual_rms"] for r in left) < 1e-5


def test_matrices_of_other_points_are_told_apart(spark):
    series, _ = gappy(spark, random_coeffs(spark, 1), 1)
    with pytest.raises(ValueError, match="2 different sets"):
        analysis.gram(series, 1)
    assert analysis.deviation(series, 1) == pytest.approx(float(np.abs(analysis.gram(series.where("epoch_id = 1"), 1) - np.eye(4)).max()))


@pytest.mark.parametrize("start", [0.0, 3.0])
def test_fft_with_gaps_equals_direct(spark, start):
    series, by = gappy(spark, random_coeffs(spark, 6, 7), 6)
    series = series.withColumn("lon", F.col("lon") + start).repartition(5)
    fast, plan = analysis.quadrature_planned(series, 6)
    assert plan.path == "fft"
    both = fast.join(analysis.quadrature(series, 6).withColumnsRenamed({"c": "c2", "s": "s2"}), ["epoch_id", "n", "m"])
    row = both.agg(F.count("*"), F.max(F.abs(F.col("c") - F.col("c2"))), F.max(F.abs(F.col("s") - F.col("s2")))).first()
    assert row[0] == 3 * 28 and row[1] < 1e-12 and row[2] < 1e-12
    holed = series.where("point_id <> 40")  # in no epoch
    assert analysis.quadrature_planned(holed, 6)[1].reason == "the points are no full grid"
    with pytest.raises(ValueError, match="full grid"):
        analysis.quadrature_planned(holed, 6, "fft")


def test_auto_is_the_same_for_one_epoch_and_for_several(spark):
    truth = random_coeffs(spark, 3)
    one = weights.dh(synthesis.synthesise(cells(spark).withColumn("lat", F.col("lat") - 5.0), truth, 3))
    two = one.withColumn("epoch_id", F.explode(F.array(F.lit(0), F.lit(1))))
    for w in (one, two):
        x, method = analysis.analyse(w, 3)
        assert method == "quadrature"
        assert gap(x.where("epoch_id = 0"), truth) < 1e-8
    series, _ = gappy(spark, truth, 3)
    assert analysis.analyse(series, 3, tau=0.5, steps=2, alpha=None)[1] == "wlsq"  # options of other methods are passed over
    assert analysis.analyse(series.where("lat > 0"), 3)[1] == "projection"
    for wrong in ({"method": "hexagons"}, {"method": "quadrature", "tau": 0.5}, {"colour": 1}):
        with pytest.raises(ValueError):
            analysis.analyse(one, 3, **wrong)


def test_order_0_stands_for_the_whole_matrix(spark, monkeypatch):
    north = weights.grid(cells(spark)).where("lat > -20")
    k = analysis.gram(north, 3)
    monkeypatch.setattr(analysis, "LARGEST", 4)
    monkeypatch.setattr(analysis, "PROBED", 0)
    assert analysis.checked_deviation(north, 3) == (pytest.approx(float(np.abs(np.diag(k)[:4] - 1).max())), "order 0")


def test_forward_formula(spark):
    truth = random_coeffs(spark, 3)
    field = weights.dh(synthesis.synthesis(cells(spark).withColumn("lat", F.col("lat") - 5.0), truth, 3, target="ewh"))
    assert gap(analysis.analyse(field, 3, "quadrature", field_unit="ewh")[0], truth) < 1e-10
    with pytest.raises(ValueError, match="physical"):
        analysis.analyse(field, 3, "quadrature", field_unit="ewh", target_unit="scalar")
    smooth = synthesis.synthesis(cells(spark), truth, 3, gaussian_km=1500.0)
    want = synthesis.synthesise(cells(spark), coeffs.smoothed(truth, 1500.0, 3), 3)
    assert smooth.exceptAll(want).count() == 0


def test_kaula_goes_by_the_first_pass(spark):
    truth = random_coeffs(spark, 4, 3)
    field = weights.uniform(synthesis.synthesise(scatter(spark), truth, 4))
    given = analysis.first_pass(field, 4)
    a, b = analysis.least_squares(field, 4, "kaula", 1e-3)[0], analysis.least_squares(field, 4, "kaula", 1e-3, degree_rms=given)[0]
    assert gap(a, b) < 1e-12 and gap(a, analysis.least_squares(field, 4, "kaula", 1e-3, scale=1e-5)[0]) > 1e-6
    assert gap(a, truth) < 1e-2


def test_gradients_of_a_series(spark):
    a, b = random_coeffs(spark, 5, 1), random_coeffs(spark, 5, 2).withColumn("epoch_id", F.lit(4))
    p = cells(spark).withColumn("epoch_id", F.explode(F.array(F.lit(0), F.lit(4), F.lit(9))))
    both = synthesis.gradient(p, a.unionByName(b), 5)
    assert both.where("epoch_id = 9 and (by_colat is not null or by_lon is not null)").count() == 0
    rows = synthesis.gradient_rows(cells(spark).select("lat").distinct(), a.unionByName(b), 5, 36)
    for e, one in ((0, a), (4, b.withColumn("epoch_id", F.lit(0)))):
        want = synthesis.gradient(cells(spark), one, 5).toPandas().sort_values("point_id")
        got = both.where(F.col("epoch_id") == e).toPandas().sort_values("point_id")
        fast = rows.where(F.col("epoch_id") == e).toPandas().sort_values(["lat", "ilon"])
        for c in ("by_colat", "by_lon"):
            assert np.allclose(got[c], want[c]) and np.allclose(fast[c], want[c])


def test_gradients_hold_a_few_orders_at_a_time():
    import tracemalloc

    lat = np.linspace(-90, 90, 20_000)
    tracemalloc.start()
    total = sum(float(d.sum()) for _, d in kernels.slopes(lat, 60)) + sum(float(q.sum()) for _, q in kernels.over_sine(lat, 60))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(total) and peak < 100e6


def test_sums_are_handed_on(spark, monkeypatch):
    series, _ = gappy(spark, random_coeffs(spark, 3), 3)
    want = analysis.quadrature(series, 3).toPandas()
    monkeypatch.setattr(analysis, "HELD_BYTES", 1)
    for got in (analysis.quadrature(series, 3), analysis.quadrature_planned(series, 3)[0]):
        both = want.merge(got.toPandas(), on=["epoch_id", "n", "m"])
        assert len(both) == len(want) and np.allclose(both["c_x"], both["c_y"]) and np.allclose(both["s_x"], both["s_y"])


def test_guards_and_texts_of_units(spark):
    love = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, -0.3, 0.1, 0.0), (2, -1.0, 0.02, -0.3)], "n int, h double, l double, k double")
    x = random_coeffs(spark, 2)
    with pytest.raises(ValueError, match="hold"):
        units.convert(x, "radial_displacement", "geopotential", love)
    empty = coeffs.without_mean(x)
    assert gap(units.convert(units.convert(empty, "geopotential", "radial_displacement", love), "radial_displacement", "geopotential", love), empty) < 1e-12
    text = units.describe_conversion(spark, 2)
    assert len(text.splitlines()) == 4 and "ewh" in text and "1 + k'_n" in units.formula("ewh")
    assert gap(units.canonical(x, "scalar"), x) == 0


def test_circles_equal_points(spark):
    """Synthesis by circles of latitude at points with gaps, in any order, for several epochs."""
    a, b = random_coeffs(spark, 5, 1), random_coeffs(spark, 5, 2).withColumn("epoch_id", F.lit(4))
    p = cells(spark).where("point_id % 7 <> 3").withColumn("lon", F.pmod(F.col("lon") + 3.0, F.lit(360.0))).withColumn("epoch_id", F.explode(F.array(F.lit(0), F.lit(4), F.lit(9)))).repartition(5)
    direct = synthesis.synthesise(p, a.unionByName(b), 5).toPandas().sort_values(["epoch_id", "point_id"])
    fast = synthesis.synthesise(p, a.unionByName(b), 5, circle=(3.0, 36)).toPandas().sort_values(["epoch_id", "point_id"])
    assert np.allclose(direct["value"], fast["value"], equal_nan=True) and fast["value"].isna().sum() == len(p.where("epoch_id = 9").collect())
    with pytest.raises(ValueError, match="order"):
        synthesis.synthesise(p, a, 5, circle=(3.0, 10))
