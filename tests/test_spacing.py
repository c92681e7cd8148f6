"""Nearest points however far, and counts within a cap, against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from orbweave.functions import geo
from orbweave.operators import hull, mesh, places, weights
from orbweave.plans import planner


def mixed():
    """Some everywhere, a dense cluster, many at one place and at the poles, and lone ones."""
    rng = np.random.default_rng(5)
    lat = [np.degrees(np.arcsin(rng.uniform(-1, 1, 60))), 40 + rng.normal(0, 1e-3, 700), np.full(300, -20.0), [90.0, 90.0, -90.0, 89.95, 89.9, -89.99], 88 + rng.uniform(0, 2, 30)]
    lon = [rng.uniform(0, 360, 60), 10 + rng.normal(0, 1e-3, 700), np.full(300, 77.0), [0.0, 120.0, 5.0, 10.0, 190.0, 33.0], rng.uniform(-180, 180, 30)]
    lat, lon = np.concatenate(lat), np.concatenate(lon)
    return pd.DataFrame({"point_id": np.arange(len(lat)), "lat": lat, "lon": lon})


def angles(p):
    x = hull.unit(p["lat"].to_numpy(), p["lon"].to_numpy())
    return np.degrees(2 * np.arcsin(np.clip(np.linalg.norm(x[:, None] - x[None], axis=2) / 2, 0, 1)))


@pytest.mark.parametrize("case", ["mixed", "far", "pair"])
def test_nearest_however_far(spark, case):
    p = mixed()
    if case != "mixed":
        p = pd.DataFrame({"point_id": [0, 1, 2, 3], "lat": [0.0, 50.0, -60.0, 0.0], "lon": [0.0, 100.0, 200.0, 310.0]})[: 4 if case == "far" else 2]
    d = angles(p)
    np.fill_diagonal(d, np.inf)
    got = weights.spacing(spark.createDataFrame(p)).toPandas().sort_values("point_id")
    assert len(got) == len(p)
    assert np.abs(got["degrees"].to_numpy() - d.min(1)).max() < 1e-9


def test_one_place_alone(spark):
    one = pd.DataFrame({"point_id": [0], "lat": [1.0], "lon": [2.0]})
    assert weights.spacing(spark.createDataFrame(one)).first()["degrees"] is None
    assert weights.spacing(spark.createDataFrame(pd.concat([one, one.assign(point_id=1)]))).first()["degrees"] == 0.0


def test_counts_within_a_cap(spark):
    p = mixed()
    got = weights.cap_density(spark.createDataFrame(p), 7.0).toPandas().sort_values("point_id")
    n = (angles(p) <= 7.0).sum(1)
    assert np.allclose(got["w"], 2 * np.pi * (1 - np.cos(np.radians(7.0))) / n)


def test_places_join_once(spark):
    """2000 points at one place are one row where pairs are formed."""
    p = spark.range(2000).selectExpr("id as point_id", "10.0D as lat", "20.0D as lon")
    assert [tuple(r) for r in places.spots(p).collect()] == [(10.0, 20.0, 2000)]
    assert weights.cap_density(p, 5.0).count() == 2000


def clustered(kind):
    rng = np.random.default_rng(4)
    if kind == "globe":
        lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 3000))), rng.uniform(0, 360, 3000)
    elif kind == "mixed":
        p = mixed().drop_duplicates(["lat", "lon"])
        return p[~((p["lat"] == 90.0) & (p["lon"] > 0))].reset_index(drop=True)
    elif kind == "cap":
        lat, lon = np.degrees(np.arcsin(rng.uniform(0.95, 1, 1500))), rng.uniform(0, 360, 1500)
    elif kind == "lattice":
        lat, lon = (g.ravel() for g in np.meshgrid(np.arange(20.0, 32.0, 0.4), np.arange(100.0, 118.0, 0.4)))
    else:
        lat, lon = (g.ravel() for g in np.meshgrid(np.arange(-85.0, 90.0, 10.0), np.arange(0.0, 360.0, 10.0)))
    return pd.DataFrame({"point_id": np.arange(len(lat)), "lat": lat, "lon": lon})


@pytest.mark.parametrize("kind", ["globe", "mixed", "cap", "lattice", "grid"])
def test_tiles_give_the_areas_of_the_whole_hull(spark, kind, monkeypatch):
    monkeypatch.setattr(mesh, "MANY", 40)
    monkeypatch.setattr(mesh, "CROWD", 160)
    p = clustered(kind)
    lat, lon = p["lat"].to_numpy(), p["lon"].to_numpy()
    df = spark.createDataFrame(p)
    v, d = (rule(df).toPandas().sort_values("point_id")["w"].to_numpy() for rule in (weights.voronoi, weights.delaunay))
    assert len(v) == len(d) == len(p)
    assert v.sum() == pytest.approx(4 * np.pi)
    assert np.abs(v - hull.voronoi_areas(lat, lon)).max() < 1e-8
    assert np.abs(d - hull.delaunay_areas(lat, lon)).max() < 1e-8


def test_many_points(spark):
    n = 200_001
    p = geo.fibonacci(spark.range(n).withColumnRenamed("id", "point_id"), "point_id", n)
    assert planner.guess_rule(p) == "voronoi"
    row = weights.report(weights.weigh(p)).first()
    assert row["n_points"] == n and row["total"] == pytest.approx(4 * np.pi) and row["heterogeneity"] < 2


def test_a_series_has_one_set_of_points(spark):
    """Two epochs, one of them with a point less, weigh as the points of one."""
    p = spark.createDataFrame(clustered("globe")[:200])
    series = p.withColumn("epoch_id", F.explode(F.array(F.lit(0), F.lit(3)))).where("not (epoch_id = 3 and point_id = 7)")
    for rule in (weights.uniform, weights.voronoi, lambda x: weights.cap_density(x, 20.0)):
        one = rule(p).select("point_id", "w").toPandas().set_index("point_id")["w"]
        two = rule(series).toPandas()
        assert len(two) == 399 and np.allclose(two["w"], one[two["point_id"]])
        assert weights.report(rule(series)).first()["n_points"] == 200
    total = weights.normalised(series.withColumn("w", F.lit(0.5))).groupBy("epoch_id").agg(F.sum("w").alias("w")).orderBy("epoch_id").collect()
    assert total[0]["w"] == pytest.approx(4 * np.pi) and total[1]["w"] == pytest.approx(4 * np.pi * 199 / 200)
    grid = spark.createDataFrame(clustered("grid")).withColumn("epoch_id", F.explode(F.array(F.lit(0), F.lit(1))))
    assert planner.guess_rule(grid) == "dh" and planner.guess_rule(series) == "voronoi"
    assert weights.spacing(series).count() == 200


def test_subsets_and_tables_of_weights(spark):
    p = spark.createDataFrame(clustered("globe")[:50])
    half = weights.weigh(p, "uniform", subset=F.col("point_id") < 25)
    assert half.count() == 25 and half.first()["w"] == pytest.approx(4 * np.pi / 25)
    table = p.select("point_id", (F.col("point_id") + 1.0).alias("w"))
    assert weights.weigh(p, "user", user=table).agg(F.sum("w")).first()[0] == pytest.approx(50 * 51 / 2)
    with pytest.raises(Exception, match="no weight for point 9"):
        weights.weigh(p, "user", user=table.where("point_id <> 9")).collect()


def test_axes_are_ordered_in_ranges(spark):
    """Neighbours on an axis of many values, with no window over all of them."""
    v = spark.createDataFrame(pd.DataFrame({"v": np.random.default_rng(1).permutation(np.arange(5000.0) ** 1.5)}))
    got = places.beside(v, "v")
    rows = got.toPandas().sort_values("v").reset_index(drop=True)
    assert rows["_p"][1:].tolist() == rows["v"][:-1].tolist() and rows["_n"][:-1].tolist() == rows["v"][1:].tolist()
    assert rows["_p"].isna().sum() == rows["_n"].isna().sum() == 1 and (rows["_a"] == 0).all() and (rows["_b"] == rows["v"].max()).all()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lag(v") == 1 and "lag(v#" in plan and "[_r" in plan
