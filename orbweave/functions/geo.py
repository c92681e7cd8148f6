"""Geometry on the sphere as column expressions; degrees in and out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUR_PI = 12.566370614359172
MEAN_RADIUS_KM = 6371.0


def wrapped(lon: Column) -> Column:
    """Longitude in [0, 360)."""
    return F.pmod(lon.cast("double"), F.lit(360.0))


def snapped(v: Column, step: float) -> Column:
    """A coordinate of single precision on the lattice of a step."""
    return F.round(v / F.lit(step)) * F.lit(step)


def west_east(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon.cast("double") + 180.0, F.lit(360.0)) - 180.0


def lonlat_to_xyz(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def xyz_to_lonlat(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    r = F.sqrt(x * x + y * y + z * z)
    return wrapped(F.degrees(F.atan2(y, x))), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / r))))


def sphere_area(radius: float = 1.0) -> float:
    return FOUR_PI * radius**2


def triangle_area(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """Area of the spherical triangle of three unit vectors."""
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    triple = a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    return 2.0 * F.atan2(F.abs(triple), 1.0 + dot(a, b) + dot(b, c) + dot(c, a))


def azimuth(east: Column, north: Column) -> Column:
    """Clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def magnitude(east: Column, north: Column) -> Column:
    return F.hypot(east, north)


def unknowns(nmax: Column) -> Column:
    return (nmax + 1) * (nmax + 1)


def sine_unknowns(nmax: Column) -> Column:
    """Of the unknowns those of sines, m > 0."""
    return nmax * (nmax + 1) / 2


def degree_and_order(place: Column, nmax: int) -> tuple[Column, Column]:
    """n and m of a place in ``triangle_index``."""
    m = F.floor((2 * nmax + 3 - F.sqrt((2 * nmax + 3) * (2 * nmax + 3) - 8.0 * place)) / 2.0 + 1e-9).cast("long")
    return place - (m * F.lit(nmax + 1) - (m * (m - 1) / 2).cast("long")) + m, m


def equivalent_lat_step(mean_weight: Column) -> Column:
    """The latitude (degrees) at which a cell of one degree by one has this mean weight; 0 for larger ones, null for none."""
    return F.when(mean_weight > 0, F.degrees(F.acos(F.least(F.lit(1.0), mean_weight / F.lit(0.017453292519943295**2)))))


def triangle_index(n: Column, m: Column, nmax: int) -> Column:
    """Place of (n, m) when orders come one after another, each by degree."""
    return m * F.lit(nmax + 1) - (m * (m - 1) / 2).cast("long") + (n - m)


def resolution_km(n: Column) -> Column:
    """Half wavelength of a degree; infinite at 0."""
    return F.when(n > 0, F.lit(3.141592653589793 * MEAN_RADIUS_KM) / n).otherwise(F.lit(float("inf")))


def recommended_degree(points: Column, coverage: Column) -> Column:
    """The highest degree with twice as many points as unknowns on the covered part."""
    return F.greatest(F.lit(0.0), F.floor(F.sqrt(points / (coverage * 2.0))) - 1).cast("int")


def fibonacci(points, index: str, total: int):
    """points with lat and lon of the index-th of ``total`` points of a Fibonacci sphere."""
    i = F.col(index).cast("double")
    t = 1.0 - 2.0 * (i + 0.5) / F.lit(float(total))
    turn = F.lit(3.141592653589793 * (1.0 + 5.0**0.5))
    return points.withColumn("lat", F.degrees(F.asin(t))).withColumn("lon", wrapped(F.degrees(F.pmod(turn * i, F.lit(6.283185307179586)))))
