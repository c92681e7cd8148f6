"""Blocks of epochs and what iterates over them, against sums point by point and dense solves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbweave.functions.kernels import design, ordinals
from orbweave.operators import analysis, blocks, report, slepian, synthesis, timeaxis, weights


def rows_of(kind: str, rng) -> list[np.ndarray]:
    if kind == "lattice":  # with gaps, uneven steps and a place that one epoch has twice
        lat, lon = (x.ravel() for x in np.meshgrid(np.sort(rng.uniform(-80, 80, 9)), np.sort(rng.uniform(0, 360, 14)), indexing="ij"))
    else:
        lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 80))), rng.uniform(0, 360, 80)
    epochs = [3, 5, 9]
    lat, lon, e = np.tile(lat, 3), np.tile(lon, 3), np.repeat(epochs, len(lat))
    w, v = rng.uniform(0.1, 1, len(lat) // 3), rng.normal(size=len(lat))
    keep = rng.uniform(size=len(lat)) > 0.2
    rows = [x[keep] for x in (lat, lon, np.tile(w, 3), v, e)]
    if kind == "twice":
        rows = [np.concatenate([x, x[:5]]) for x in rows]
        rows[2][-3:] *= 2
    if kind == "apart":  # no two epochs share a place
        rows[0] = rows[0] + rows[4] * 1e-3
    return rows


@pytest.mark.parametrize("kind", ["lattice", "scatter", "twice", "apart"])
def test_blocks_hold_all_rows_and_give_their_sums(kind, monkeypatch):
    if kind == "apart":
        monkeypatch.setattr(blocks, "SPARE", 1)
        monkeypatch.setattr(blocks, "SLACK", 0)
    rows = rows_of(kind, np.random.default_rng(3))
    lat, lon, w, v, e = rows
    got = list(blocks.block_of(*rows))
    assert len(got) == (3 if kind == "apart" else 1) and (kind != "lattice" or got[0].lattice is not None) and (kind != "scatter" or got[0].lattice is None)
    back = [(float(b.lat[i]), float(b.lon[i]), float(b.w[i]), float(b.vals[i, k]), int(x)) for b in got for k, x in enumerate(b.epochs) for i in np.flatnonzero(~np.isnan(b.vals[:, k]))]
    assert sorted(back) == sorted(zip(*(x.tolist() for x in rows)))
    part, n, m = analysis.spots(4)
    a = design(lat, lon, 4)
    for b in got:
        sums = blocks.analysed(b, 4)[part, n, m]
        want = np.stack([(w * v)[e == x] @ a[e == x] for x in b.epochs], 1)
        assert np.allclose(sums, want, atol=1e-10)
        c = np.random.default_rng(1).normal(size=(25, len(b.epochs)))
        square = np.zeros((2, 5, 5, len(b.epochs)))
        square[part, n, m] = c
        assert np.allclose(blocks.synthesised(b, square), design(b.lat, b.lon, 4) @ c, atol=1e-10)


def test_circles_of_blocks_by_fft():
    lat, lon = (x.ravel() for x in np.meshgrid(np.arange(-60.0, 61, 30), 3.0 + np.arange(0, 360, 10.0), indexing="ij"))
    keep = np.random.default_rng(0).uniform(size=len(lat)) > 0.3
    b = blocks.Block(lat[keep], lon[keep], np.cos(np.radians(lat[keep])), np.array([0]), np.random.default_rng(1).normal(size=(int(keep.sum()), 1)))
    assert np.allclose(blocks.analysed(b, 6), blocks.analysed(b, 6, circle=(3.0, 36)), atol=1e-10)


@pytest.fixture(scope="module")
def series(spark):
    """Three epochs of a field to degree 20 with noise, on a 6 degree grid of which the second lacks a cap."""
    rng = np.random.default_rng(5)
    grid = synthesis.grid_points(spark, 6.0, 6.0, closed=False).where("abs(lat) < 90")
    x = {e: rng.normal(size=441) / np.array([n + 1.0 for _, n, _ in ordinals(20)]) for e in (1, 2, 4)}
    coeffs = analysis.to_coeffs(spark, 20, x)
    points = synthesis.over_epochs(weights.grid(grid), coeffs, 20).withColumn("value", F.col("value") + 0.1 * F.sin(F.col("point_id") * 1.7))
    return points.where("epoch_id <> 2 or lat < 60").persist()


def by_epoch(coeffs):
    return analysis.flat(coeffs, 20)


def test_stored_blocks_stand_for_points(spark, series, monkeypatch):
    monkeypatch.setattr(blocks, "PLACES", 100)
    held = analysis.held_blocks(series)
    assert held.agg(F.max(F.size("lat"))).first()[0] <= 100
    a, b = by_epoch(analysis.quadrature(series, 20)), by_epoch(analysis.quadrature(held, 20))
    assert a.keys() == b.keys() == {1, 2, 4} and all(np.allclose(a[e], b[e], atol=1e-12) for e in a)
    c = analysis.to_coeffs(spark, 20, a)
    for x, y in zip(analysis.residuals(series, c, 20).orderBy("epoch_id").collect(), analysis.residuals(held, c, 20).orderBy("epoch_id").collect()):
        assert np.allclose(tuple(x), tuple(y))
    planned, plan = analysis.quadrature_planned(held, 20)
    assert plan.path == "fft" and all(np.allclose(v, a[e], atol=1e-12) for e, v in by_epoch(planned).items())


@pytest.mark.parametrize("reg", ["none", "kaula"])
def test_iterations_equal_the_direct_solve(series, monkeypatch, reg):
    how = {} if reg == "none" else {"reg": "kaula", "alpha": 0.3, "scale": 10.0}
    rows = series.where("epoch_id = 1") if reg == "none" else series  # with a gap and no penalty there is little to agree on
    direct, _ = analysis.least_squares(rows, 20, **how)
    monkeypatch.setattr(analysis, "LARGEST", 100)
    found, info = analysis.least_squares(rows, 20, **how)
    want, got = by_epoch(direct), by_epoch(found)
    assert want.keys() == got.keys() and info["iterations"] < 60
    assert all(np.abs(got[e] - want[e]).max() < 1e-7 * np.abs(want[e]).max() for e in want)


def test_least_squares_at_degree_90(spark):
    """8281 unknowns: a 2 degree grid without a polar cap, with a penalty by degree, in few passes."""
    rng = np.random.default_rng(0)
    truth = rng.normal(size=8281) / np.array([(n + 1.0) ** 2 for _, n, _ in ordinals(90)])
    grid = synthesis.grid_points(spark, 1.5, 1.5, closed=False).where("lat > -86")
    points = synthesis.synthesise(weights.grid(grid), analysis.to_coeffs(spark, 90, {0: truth}), 90)
    found, info = analysis.least_squares(points, 90, reg="kaula", alpha=1e-4, scale=1.0)
    assert info["iterations"] <= 60
    x, pull = analysis.flat(found, 90)[0], (1e-4 * analysis.penalty("kaula", 90, scale=1.0)) ** 2
    rest = synthesis.synthesise(points, found, 90, out="fit").withColumn("value", F.col("value") - F.col("fit"))
    slope, whole = (4 * np.pi * analysis.flat(analysis.quadrature(p, 90), 90)[0] for p in (rest, points))
    assert np.abs(slope - pull * x).max() < 1e-8 * np.abs(whole).max()  # the normal equations hold


def test_functions_of_a_cap_without_a_matrix(spark, monkeypatch):
    cap = weights.grid(synthesis.grid_points(spark, 4.0, 4.0, closed=False)).where("lat > 40").persist()
    dense = slepian.basis(cap, 20)
    monkeypatch.setattr(analysis, "LARGEST", 100)
    free = slepian.basis(cap, 20, 12)
    assert np.abs(free.values - dense.values[:12]).max() < 1e-8 and free.shannon == pytest.approx(dense.shannon)
    t = free.tapers
    assert np.allclose(t.T @ t, np.eye(12), atol=1e-9)
    clear = dense.values[:40] > 0.5
    span = dense.tapers[:, :40][:, clear]
    use = t[:, free.values > 0.999]
    assert np.allclose(np.linalg.norm(span.T @ use, axis=0), 1.0, atol=1e-6)


def test_batches_of_rows_or_of_blocks():
    rows = rows_of("lattice", np.random.default_rng(2))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["lat", "lon", "w", "value", "epoch_id"])
    one = next(blocks.blocks_in(iter([batch.slice(0, 50), batch.slice(50)])))
    assert int((~np.isnan(one.vals)).sum()) == len(rows[0])
    assert list(blocks.blocks_in(iter([]))) == []


def counted(points):
    """The points, and how often their rows have been read so far."""
    spark = points.sparkSession
    n, seen = points.count(), spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return points.mapInArrow(run, points.schema), lambda: seen.value / n


def test_points_are_read_once_or_twice(series):
    points, times = counted(series.select("lat", "lon", "w", "value", "epoch_id"))
    report.series_report(points, analysis.quadrature(points, 4), 4).collect()
    assert times() <= 2
    points, times = counted(series.select("lat", "lon", "w", "value", "epoch_id"))
    row = report.report_row(points, analysis.quadrature(points, 4), 4, "quadrature")
    assert times() <= 2 and row["gram_checked"] == "full"
    points, times = counted(series.select("lat", "lon", "w", "value", "epoch_id"))
    assert len(list(analysis.normals(points, 4))) == 2  # sets of points
    assert times() <= 1


def test_tiles_make_the_matrix(series, monkeypatch):
    monkeypatch.setattr(analysis, "TILE", 7)
    monkeypatch.setattr(blocks, "PLACES", 300)
    rows = series.toPandas()
    found = list(analysis.normals(series, 5))
    assert sorted(e for eq in found for e in eq.rhs) == [1, 2, 4]
    for eq in found:
        for e, b in eq.rhs.items():
            mine = rows[rows["epoch_id"] == e]
            a, w, f = design(mine["lat"].to_numpy(), mine["lon"].to_numpy(), 5), mine["w"].to_numpy(), mine["value"].to_numpy()
            assert np.allclose(eq.matrix, (a * w[:, None]).T @ a, atol=1e-10) and np.allclose(b, (w * f) @ a, atol=1e-10) and np.isclose(eq.power[e], (w * f * f).sum())


def test_probes_stand_for_the_matrix(series, monkeypatch):
    whole, how = analysis.checked_deviation(series, 6)
    assert how == "full"
    monkeypatch.setattr(analysis, "WHOLE", 0)
    probed, how = analysis.checked_deviation(series, 6)
    assert how == "probe"
    rows = max(np.linalg.norm(eq.matrix / (4 * np.pi) - np.eye(49), axis=1).max() for eq in analysis.normals(series, 6, rhs=False))
    assert whole * 0.9 < probed < 3 * rows and 0.3 * rows < probed
    monkeypatch.undo()
    assert analysis.judged_by(65_160, 1, 60) == "probe" and analysis.judged_by(648, 1, 8) == "full" and analysis.judged_by(10**10, 1, 60) == "order 0"


def test_runs_on_an_axis_without_a_single_task(spark):
    """Against one pass over the sorted rows, whatever the ranges; equal dates among them."""
    rng = np.random.default_rng(4)
    secs = np.concatenate([rng.integers(0, 400_000, 300), np.full(100, 5000), [7, 8]]) * 60
    rows = spark.createDataFrame([(k, int(s)) for k, s in enumerate(secs)], "epoch_id long, s long").select("epoch_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts")).repartition(4)
    order = sorted(range(len(secs)), key=lambda k: (secs[k], k))
    gaps = {k: (secs[k] - secs[order[i - 1]]) / 86400 if i else None for i, k in enumerate(order)}
    got = {r["epoch_id"]: r["gap_days"] for r in timeaxis.with_gaps(rows).collect()}
    assert got.keys() == gaps.keys() and all((g is None and got[k] is None) or got[k] == pytest.approx(g) for k, g in gaps.items())
    run, runs = 0, {}
    for k in order:
        run += gaps[k] is None or gaps[k] >= 0.5
        runs.setdefault(run, []).append(k)
    want = {k: n for n, of in runs.items() if len(of) > 1 for k in of}
    found = timeaxis.duplicates(rows, 0.5)
    assert {r["epoch_id"]: r["run"] for r in found.collect()} == want
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["epoch_id"] for r in timeaxis.missing(rows, 1.0).collect()} == {k for k, g in gaps.items() if g is not None and g > 1.0}
    assert timeaxis.with_gaps(rows.limit(0)).count() == timeaxis.duplicates(rows.limit(0)).count() == 0
