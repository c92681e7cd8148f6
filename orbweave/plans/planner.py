"""Rules, methods and kernels chosen from one aggregate row about the points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators.places import beside


def layout(points: DataFrame) -> DataFrame:
    """One row about the distinct places: n, nlat, nlon, lat_min, lat_max, lon_span, is_grid, is_lattice. The points of a
    series are those of all its epochs."""
    places = points.select("lat", "lon").distinct()
    row = places.agg(F.count("*").alias("n"), F.countDistinct("lat").alias("nlat"), F.countDistinct("lon").alias("nlon"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), (F.max("lon") - F.min("lon")).alias("lon_span"))
    row = row.withColumn("is_grid", F.col("nlat") * F.col("nlon") == F.col("n"))
    a, b = (_regular(places, v).withColumnRenamed("regular", f"_{v}") for v in ("lat", "lon"))
    return row.join(a).join(b).withColumn("is_lattice", F.col("_lat") & F.col("_lon")).drop("_lat", "_lon")  # rows of one


def _regular(places: DataFrame, v: str) -> DataFrame:
    """One row: regular, whether four fifths of the gaps are within 1.5 times the least and those within 5 %."""
    gaps = beside(places.select(v).distinct(), v).select((F.col("_n") - F.col(v)).alias("g")).where("g is not null")
    gaps = gaps.join(F.broadcast(gaps.agg(F.min("g").alias("low")))).withColumn("base", F.col("g") <= 1.5 * F.col("low"))
    share, spread = F.avg(F.col("base").cast("double")), F.max(F.when(F.col("base"), F.col("g"))) / F.min("g") - 1.0
    return gaps.agg(F.coalesce((F.count("*") >= 2) & (F.min("g") > 0) & (share >= 0.8) & (spread <= 0.05), F.lit(False)).alias("regular"))


def rule_row(points: DataFrame) -> DataFrame:
    """The layout row with the rule that suits it."""
    everywhere = F.col("lon_span") > 300.0
    full = F.when((F.col("nlon") == 2 * F.col("nlat")) & (F.col("nlat") % 2 == 0), "dh").otherwise("grid")
    rule = F.when(F.col("is_grid") & everywhere, full).when(everywhere & (F.col("lat_max") > 60.0) & (F.col("lat_min") < -60.0), "voronoi")
    return layout(points).withColumn("rule", rule.when(F.col("is_grid"), "grid").when(F.col("is_lattice"), "lattice").otherwise("delaunay"))


def guess_rule(points: DataFrame) -> str:
    return rule_row(points).first()["rule"]


@dataclass(frozen=True)
class LongitudePlan:
    path: str  # fft or direct
    reason: str
    first_lon: float = 0.0
    nlon: int = 0


def plan_longitude(points: DataFrame, nmax: int, wanted: str = "auto") -> LongitudePlan:
    """fft needs a full grid with evenly spaced longitudes around the whole circle and more than 2 nmax of them. Where it
    doesn't fit, ``fft`` raises and ``auto`` goes the direct way with the reason. points: distinct lat and lon."""
    if wanted not in ("auto", "fft", "direct"):
        raise ValueError(f"unknown way {wanted!r}")
    if wanted == "direct":
        return LongitudePlan("direct", "asked for")
    row = points.agg(F.count("*").alias("n"), F.countDistinct("lat").alias("nlat"), F.countDistinct("lon").alias("nlon"), F.min("lon").alias("lo"), F.max("lon").alias("hi")).first()
    reason = ""
    if not row["n"] or row["nlat"] * row["nlon"] != row["n"]:
        reason = "the points are no full grid"
    elif row["nlon"] <= 2 * nmax:
        reason = f"{row['nlon']} longitudes don't resolve order {nmax}"
    else:
        step = 360.0 / row["nlon"]
        if abs(row["hi"] - row["lo"] + step - 360.0) > 360.0 * 1e-9:
            reason = "the longitudes don't go around"
        else:
            off = points.select("lon").distinct().select(F.max(F.abs(F.pmod(F.col("lon") - row["lo"] + step / 2, F.lit(step)) - step / 2))).first()[0]
            reason = "" if off <= 360.0 * 1e-9 else "the longitudes are uneven"
    if reason and wanted == "fft":
        raise ValueError(reason)
    return LongitudePlan("direct", reason) if reason else LongitudePlan("fft", "full even circle", row["lo"], row["nlon"])


def choose_method(gram_deviation: float, coverage: float, points: int, unknowns: int, dense: int = 4000) -> str:
    """quadrature where it is exact enough, projection on a part of the sphere, else least squares. Exactness and points
    are those of the epoch that is worst off."""
    if gram_deviation < 1e-2 and abs(coverage - 1.0) < 1e-3 and points >= 2 * unknowns:
        return "quadrature"
    if coverage < 0.999:
        return "projection"
    return "wlsq" if unknowns <= dense else "cg"
