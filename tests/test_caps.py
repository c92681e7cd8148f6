"""Counts within caps by tiles and leaves, against every pair of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from orbweave.operators import caps, hull, places, weights


def scattered():
    """Some everywhere, a dense cluster, a ring of 7 degrees around it, several at one place, and both poles."""
    rng = np.random.default_rng(8)
    turn = rng.uniform(0, 2 * np.pi, 300)
    lat = [np.degrees(np.arcsin(rng.uniform(-1, 1, 900))), 1 + rng.normal(0, 1e-3, 500), 1 + 7 * np.sin(turn), np.full(9, -60.0), [90.0, 90.0, -90.0, 89.9]]
    lon = [rng.uniform(0, 360, 900), rng.normal(0, 1e-3, 500), 7 * np.cos(turn), np.full(9, 12.0), [0.0, 120.0, 5.0, 33.0]]
    lat, lon = np.concatenate(lat), np.concatenate(lon)
    return pd.DataFrame({"point_id": np.arange(len(lat)), "lat": lat, "lon": lon})


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(caps, "FEW", 70)
    monkeypatch.setattr(caps, "NEAR", 3)


def counted(spark, p, radius):
    n = caps.counts(places.spots(spark.createDataFrame(p)), radius)
    return places.spot(spark.createDataFrame(p)).join(n, ["la", "lo"]).toPandas().sort_values("point_id")["n"].to_numpy()


def test_counts_of_tiles_are_those_of_pairs(spark, small_tiles):
    p = scattered()
    x = hull.unit(p["lat"].to_numpy(), p["lon"].to_numpy())
    pairs = np.degrees(2 * np.arcsin(np.clip(np.linalg.norm(x[:, None] - x[None], axis=2) / 2, 0, 1)))
    for radius in (0.001, 7.0, 90.0, 130.0, 180.0):
        assert (counted(spark, p, radius) == (pairs <= radius).sum(1)).all()


def test_a_place_counts_its_own_points_at_any_radius(spark):
    p = scattered()
    own = places.spot(spark.createDataFrame(p)).withColumn("n", F.expr("count(*) over (partition by la, lo)"))
    assert (counted(spark, p, 0.0) == own.toPandas().sort_values("point_id")["n"].to_numpy()).all()


def test_pairs_at_the_radius_go_by_the_formula(spark, small_tiles):
    lat, lon = (g.ravel() for g in np.meshgrid(np.arange(-85.0, 90.0, 10.0), np.arange(0.0, 360.0, 10.0)))
    p = pd.DataFrame({"point_id": np.arange(len(lat)), "lat": lat, "lon": lon})
    a = spark.createDataFrame(p)
    b = a.toDF("id2", "lat2", "lon2")
    la, lb = F.radians("lat"), F.radians("lat2")
    cosine = F.sin(la) * F.sin(lb) + F.cos(la) * F.cos(lb) * F.cos(F.radians("lon") - F.radians("lon2"))
    for radius in (10.0, 30.0):
        want = a.crossJoin(b).where((cosine >= float(np.cos(np.radians(radius)))) | (F.col("point_id") == F.col("id2"))).groupBy("point_id").count()
        assert (counted(spark, p, radius) == want.toPandas().sort_values("point_id")["count"].to_numpy()).all()


def test_a_cluster_forms_no_pairs(spark):
    """30,000 places within each other's caps: every pair of them was a row of a join."""
    p = spark.range(30_000).select(F.col("id").alias("point_id"), (F.col("id") * 1e-5).alias("lat"), (F.col("id") % 173 * 1e-3).alias("lon"))
    got = weights.cap_density(p, 3.0)
    assert "la2" not in got._jdf.queryExecution().optimizedPlan().toString()
    row = got.agg(F.count("*").alias("n"), F.min("w").alias("low"), F.max("w").alias("high")).first()
    assert row["n"] == 30_000 and row["low"] == row["high"] == pytest.approx(2 * np.pi * (1 - np.cos(np.radians(3.0))) / 30_000)


def test_rows_without_a_place(spark):
    none = spark.createDataFrame([], "point_id long, lat double, lon double")
    assert weights.cap_density(none, 5.0).count() == 0
    odd = spark.createDataFrame([(0, None, 1.0), (1, 2.0, None), (2, float("nan"), 1.0), (3, 1.0, float("inf")), (4, float("inf"), 1.0), (5, 2.0, -1.0), (6, 2.0, 359.0)], none.schema)
    area = 2 * np.pi * (1 - np.cos(np.radians(5.0)))
    assert {r["point_id"]: r["w"] for r in weights.cap_density(odd, 5.0).collect()} == {4: area, 5: area / 2, 6: area / 2}
