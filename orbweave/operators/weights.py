"""Integration weights of points: solid angles by rule.

Every rule takes points (point_id, lat, lon, ...) and gives them with a column w. A series (epoch_id) has one set of
points, those of all its epochs together, and a point has one weight in all of them. Axis rules aggregate the distinct
coordinates first and join their cells back by the exact value, so points are never sorted or gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.geo import FOUR_PI
from orbweave.operators import caps, mesh, places
from orbweave.operators.places import beside, sites, spacing

__all__ = ["RULES", "cap_density", "delaunay", "dh", "glq_grid", "grid", "lattice", "normalised", "report", "spacing", "uniform", "voronoi", "weigh"]

RULES = ("dh", "glq", "grid", "lattice", "voronoi", "delaunay", "uniform", "user", "auto")


def _edges(axis: DataFrame, v: str, turn: float | None = None, clip: tuple[float, float] | None = None) -> DataFrame:
    """axis (one row for each distinct v) with lo and hi: midpoints to the neighbours; at the ends half a gap further, or
    half of the gap around the circle where the axis spans more than ``turn``; a single value gets one degree."""
    x = beside(axis, v)
    round_ = (F.col("_a") + 360.0 - F.col("_b")) * 0.5
    open_lo = F.coalesce(F.col(v) - 0.5 * (F.col("_n") - F.col(v)), F.col(v) - 0.5)
    open_hi = F.coalesce(F.col(v) + 0.5 * (F.col(v) - F.col("_p")), F.col(v) + 0.5)
    around = F.col("_b") - F.col("_a") > turn if turn is not None else F.lit(False)
    lo = F.coalesce((F.col("_p") + F.col(v)) * 0.5, F.when(around, F.col(v) - round_).otherwise(open_lo))
    hi = F.coalesce((F.col("_n") + F.col(v)) * 0.5, F.when(around, F.col(v) + round_).otherwise(open_hi))
    if clip:
        lo, hi = (F.least(F.greatest(e, F.lit(clip[0])), F.lit(clip[1])) for e in (lo, hi))
    return x.select(*axis.columns, lo.alias("lo"), hi.alias("hi"))


def lat_bands(points: DataFrame) -> DataFrame:
    """lat, band: sin(upper edge) - sin(lower edge) of each distinct latitude."""
    axis = _edges(points.select("lat").distinct(), "lat", clip=(-90.0, 90.0))
    return axis.select("lat", (F.sin(F.radians("hi")) - F.sin(F.radians("lo"))).alias("band"))


def lon_cells(points: DataFrame) -> DataFrame:
    """lon, cell: width in radians of each distinct longitude; the axis is a circle where it spans more than 180."""
    axis = _edges(points.select("lon").distinct(), "lon", turn=180.0)
    return axis.select("lon", F.radians(F.col("hi") - F.col("lo")).alias("cell"))


def grid(points: DataFrame) -> DataFrame:
    """Exact areas of latitude-longitude cells between midpoints."""
    return points.join(lat_bands(points), "lat").join(lon_cells(points), "lon").withColumn("w", F.col("band") * F.col("cell")).drop("band", "cell")


def dh(points: DataFrame) -> DataFrame:
    """Driscoll-Healy weights of a global grid with an even number of latitudes."""
    n = points.agg(F.countDistinct("lat").alias("lat"), F.countDistinct("lon").alias("lon")).first()
    if n["lat"] % 2:
        raise ValueError("this rule needs an even number of latitudes")
    colat = F.radians(F.lit(90.0) - F.col("lat"))
    terms = F.sequence(F.lit(0), F.lit(n["lat"] // 2 - 1))
    total = F.aggregate(F.transform(terms, lambda k: F.sin((2.0 * k + 1.0) * colat) / (2.0 * k + 1.0)), F.lit(0.0), lambda s, x: s + x)
    band = F.lit(4.0 / n["lat"]) * F.sin(colat) * total
    return points.withColumn("w", band * F.lit(2.0 * np.pi / n["lon"]))


def glq_grid(spark: SparkSession, nmax: int) -> DataFrame:
    """The Gauss-Legendre grid on which fields up to degree nmax are recovered exactly: ilat, ilon, lat, lon, w."""
    if nmax < 1:
        raise ValueError("nmax must be 1 or more")
    x, g = np.polynomial.legendre.leggauss(nmax + 1)
    n = 2 * nmax + 1
    rows = pd.DataFrame({"ilat": np.arange(nmax + 1), "lat": np.degrees(np.arcsin(x)), "g": g})
    lats = spark.createDataFrame(rows, "ilat int, lat double, g double")
    cells = lats.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ilon"))
    return cells.select((F.col("ilat") * n + F.col("ilon")).cast("long").alias("point_id"), "ilat", "ilon", "lat", (F.col("ilon") * F.lit(360.0 / n)).alias("lon"), (F.col("g") * F.lit(2.0 * np.pi / n)).alias("w"))


def lattice_step(points: DataFrame, v: str) -> DataFrame:
    """One row: step, the median of the gaps of at most 1.5 times the least; null with fewer than three values."""
    gaps = beside(points.select(v).distinct(), v).select((F.col("_n") - F.col(v)).alias("gap")).where("gap is not null")
    g = gaps.join(F.broadcast(gaps.agg(F.min("gap").alias("low"))))
    return g.agg(F.when(F.count("*") >= 2, F.median(F.when(F.col("gap") <= 1.5 * F.col("low"), F.col("gap")))).alias("step"))


def lattice(points: DataFrame) -> DataFrame:
    """One lattice cell for each point, whatever neighbours are missing."""
    dlat = lattice_step(points, "lat").withColumnRenamed("step", "_dlat")
    dlon = lattice_step(points, "lon").withColumnRenamed("step", "_dlon")
    steps = dlat.join(dlon)  # one row
    edge = lambda s: F.sin(F.radians(F.least(F.lit(90.0), F.greatest(F.lit(-90.0), F.col("lat") + s * F.col("_dlat") / 2.0))))
    return points.join(F.broadcast(steps)).withColumn("w", (edge(1.0) - edge(-1.0)) * F.radians("_dlon")).drop("_dlat", "_dlon")


def uniform(points: DataFrame) -> DataFrame:
    """4 pi shared by all points."""
    n = sites(points).agg(F.count("*").alias("_n"))
    return points.join(F.broadcast(n)).withColumn("w", F.lit(FOUR_PI) / F.col("_n")).drop("_n")


def voronoi(points: DataFrame) -> DataFrame:
    """Areas of the spherical Voronoi cells; they sum to 4 pi even on a cap. Coinciding points are refused."""
    spots = places.spots(points)
    if spots.where("n > 1").take(1):
        raise ValueError("coinciding points have no Voronoi cells")
    return _at_places(points, mesh.areas(spots).select("la", "lo", F.col("voronoi").alias("w")))


def delaunay(points: DataFrame) -> DataFrame:
    """A third of each adjoining facet of the convex hull that the centre sees from inside the points' side. Coinciding
    points share."""
    spots = places.spots(points)
    return _at_places(points, mesh.areas(spots).join(spots, ["la", "lo"]).select("la", "lo", (F.col("delaunay") / F.col("n")).alias("w")))


def _at_places(points: DataFrame, w: DataFrame) -> DataFrame:
    return places.spot(points).join(w, ["la", "lo"]).select(*points.columns, "w")


def cap_density(points: DataFrame, radius_deg: float) -> DataFrame:
    """Cap area by number of neighbours within the radius (the point itself counts), which ``caps`` counts by places."""
    area = 2.0 * np.pi * (1.0 - np.cos(np.radians(float(radius_deg))))
    n = caps.counts(places.spots(points), float(radius_deg))
    return _at_places(points, n.select("la", "lo", (F.lit(float(area)) / F.col("n")).alias("w")))


def once(weighted: DataFrame) -> DataFrame:
    """Of a series each point with its weight once; points without epochs as they are."""
    if "epoch_id" not in weighted.columns:
        return weighted
    return weighted.groupBy(*(["point_id"] if "point_id" in weighted.columns else ["lat", "lon"])).agg(F.max("w").alias("w"))


def normalised(weighted: DataFrame) -> DataFrame:
    """Weights scaled to a sum of 4 pi over the points."""
    total = once(weighted).agg(F.sum("w").alias("_t"))
    return weighted.join(F.broadcast(total)).withColumn("w", F.col("w") * F.lit(FOUR_PI) / F.col("_t")).drop("_t")


def report(weighted: DataFrame) -> DataFrame:
    """One row: n_points, total, coverage (of 4 pi), heterogeneity (largest by least positive weight)."""
    return once(weighted).agg(
        F.count("*").alias("n_points"), F.sum("w").alias("total"), (F.sum("w") / F.lit(FOUR_PI)).alias("coverage"),
        (F.max("w") / F.min(F.when(F.col("w") > 0, F.col("w")))).alias("heterogeneity"),
    )


def notes(row: dict) -> list[str]:
    """Remarks on one row of ``report``."""
    out = []
    if row["coverage"] is not None and row["coverage"] < 0.999:
        out.append(f"the weights cover {row['coverage']:.4g} of the sphere")
    if row["coverage"] is not None and row["coverage"] > 1.001:
        out.append(f"the weights are {row['coverage']:.4g} times the sphere")
    if row["heterogeneity"] is not None and row["heterogeneity"] > 100:
        out.append(f"the largest weight is {row['heterogeneity']:.3g} times the least")
    return out


def weigh(points: DataFrame, rule: str = "auto", normalise: str = "auto", user: str | DataFrame = "w", subset: Column | None = None) -> DataFrame:
    """points with w by rule. normalise: global scales to 4 pi; region and none leave areas; auto scales none but user
    weights never. ``user`` is for the rule of that name the column of weights, or a table (point_id, w) that has one for
    every point. ``subset`` keeps some of the points, and they share the sphere as if there were no others."""
    from orbweave.plans.planner import guess_rule

    if subset is not None:
        points = points.where(subset)
    if rule == "auto":
        rule = guess_rule(points)
    if rule == "glq":
        raise ValueError("points of a Gauss-Legendre grid come with their weights from glq_grid")
    rules = {"dh": dh, "grid": grid, "lattice": lattice, "voronoi": voronoi, "delaunay": delaunay, "uniform": uniform}
    if rule == "user" and isinstance(user, DataFrame):
        given = points.drop("w").join(user.select("point_id", "w"), "point_id", "left")
        missing = F.raise_error(F.concat(F.lit("no weight for point "), F.col("point_id").cast("string"))).cast("double")
        out = given.withColumn("w", F.coalesce("w", missing))
    elif rule == "user":
        out = points.withColumn("w", F.col(user))
    elif rule in rules:
        out = rules[rule](points)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return normalised(out) if normalise == "global" else out
