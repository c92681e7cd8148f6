"""Coefficients to fields at points and on grids. Coefficients, unlike points, are few and go to every task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from orbweave.functions.kernels import columns, over_sine, slopes, waves

#: Numbers of a set of coefficients that may be sent to all tasks.
SENT = 1 << 24


def dense(coeffs: pd.DataFrame, nmax: int) -> tuple[np.ndarray, np.ndarray]:
    c, s = np.zeros((nmax + 1, nmax + 1)), np.zeros((nmax + 1, nmax + 1))
    rows = coeffs[coeffs["n"] <= nmax]
    c[rows["n"], rows["m"]], s[rows["n"], rows["m"]] = rows["c"], rows["s"]
    return c, s


def sets_of(coeffs: DataFrame, nmax: int) -> dict[int, np.ndarray]:
    """By epoch the cosine and sine parts, 2 x degrees x orders. What is lazy is computed once."""
    coeffs = coeffs if "epoch_id" in coeffs.columns else coeffs.withColumn("epoch_id", F.lit(0))
    most = SENT // 2
    rows = coeffs.where(F.col("n") <= nmax).select("epoch_id", "n", "m", "c", "s").limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"more than {most} coefficients for one call; filter epochs first")
    epoch, n, m, c, s = (x.to_numpy() for x in rows.columns)
    kinds, at = np.unique(epoch, return_inverse=True)
    out = np.zeros((len(kinds), 2, nmax + 1, nmax + 1))
    out[at, 0, n, m], out[at, 1, n, m] = c, s
    return {int(e): v for e, v in zip(kinds, out)}


def _mapped(points: DataFrame, names: list[str], run, nmax: int) -> DataFrame:
    """points with columns ``names`` that run(batch) computes from each batch of rows."""
    keep = [c for c in points.columns if c not in names]
    points = points.select(*keep)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, nmax):
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(v) for v in run(b)]], names=[*keep, *names])

    return points.mapInArrow(each, StructType([*points.schema.fields, *[StructField(n, DoubleType()) for n in names]]))


def synthesise(points: DataFrame, coeffs: DataFrame, nmax: int, out: str = "value", circle: tuple[float, int] | None = None) -> DataFrame:
    """points (lat, lon and, for series, epoch_id) with the field. Without epoch_id the coefficients are one set.
    Points of an epoch without coefficients get null. ``circle`` says that all longitudes are a first one plus whole steps
    of a part of the circle: then each circle of latitude is one inverse FFT, of which the points take their places."""
    field = evaluator(coeffs, nmax, "epoch_id" in points.columns, circle)
    return _mapped(points, [out], lambda b: [field(b)], nmax).withColumn(out, F.when(~F.isnan(out), F.col(out)))


def evaluator(coeffs: DataFrame, nmax: int, by_epoch: bool, circle: tuple[float, int] | None = None) -> Callable[[pa.RecordBatch], np.ndarray]:
    """A function of batches (lat, lon, epoch_id) to the field's values there, NaN for epochs without coefficients."""
    sets = sets_of(coeffs, nmax)
    single = not by_epoch or list(sets) == [0]
    if circle is not None and circle[1] <= 2 * nmax:
        raise ValueError(f"{circle[1]} longitudes don't resolve order {nmax}")

    def epochs_of(b: pa.RecordBatch, n: int) -> np.ndarray:
        return np.zeros(n, int) if single else b.column("epoch_id").to_numpy(zero_copy_only=False)

    def run(b: pa.RecordBatch) -> np.ndarray:
        lat, lon = (b.column(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon"))
        cos, sin = waves(lon, nmax)
        epoch = epochs_of(b, len(lat))
        at = {e: np.flatnonzero(epoch == e) for e in np.unique(epoch).tolist()}
        v = np.zeros(len(lat))
        for m, p in columns(lat, nmax):
            for e, rows in at.items():
                if e in sets:
                    c, s = sets[e]
                    v[rows] += (c[m:, m] @ p[:, rows]) * cos[m, rows] + (s[m:, m] @ p[:, rows]) * sin[m, rows]
        missing = [rows for e, rows in at.items() if e not in sets]
        if missing:
            v[np.concatenate(missing)] = np.nan
        return v

    def run_circles(b: pa.RecordBatch) -> np.ndarray:
        first_lon, nlon = circle
        lat, lon = (b.column(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon"))
        epoch = epochs_of(b, len(lat))
        at = np.rint((lon - first_lon) / (360.0 / nlon)).astype(np.int64) % nlon
        order = np.lexsort((lat, epoch))
        fresh = np.ones(len(lat), bool)
        fresh[1:] = (lat[order][1:] != lat[order][:-1]) | (epoch[order][1:] != epoch[order][:-1])
        heads = order[fresh]
        lats, place = np.unique(lat[heads], return_inverse=True)
        mine = {e: np.flatnonzero(epoch[heads] == e) for e in np.unique(epoch).tolist()}
        z = np.zeros((len(heads), nlon // 2 + 1), complex)
        for m, p in columns(lats, nmax):
            turn = np.exp(1j * m * np.radians(first_lon)) / (1 if m == 0 else 2)
            for e, rows in mine.items():
                if e in sets:
                    c, s = sets[e]
                    z[rows, m] = ((c[m:, m] - 1j * s[m:, m]) @ p)[place[rows]] * turn
        field = np.fft.irfft(z, nlon, axis=1) * nlon
        for e, rows in mine.items():
            if e not in sets:
                field[rows] = np.nan
        v = np.empty(len(lat))
        v[order] = field[np.cumsum(fresh) - 1, at[order]]
        return v

    return run_circles if circle else run


def over_epochs(points: DataFrame, coeffs: DataFrame, nmax: int, out: str = "value") -> DataFrame:
    """Every point at every epoch of the coefficients."""
    epochs = sorted(r[0] for r in coeffs.select("epoch_id").distinct().limit(SENT + 1).collect())
    if len(epochs) > SENT // (nmax + 1) ** 2:
        raise ValueError(f"{len(epochs)} epochs have too many coefficients for one call; filter epochs first")
    every = F.explode(F.split(F.lit(",".join(map(str, epochs))), ",").cast("array<int>") if epochs else F.array().cast("array<int>")).alias("epoch_id")
    return synthesise(points.drop("epoch_id").select("*", every), coeffs, nmax, out)


def grid_points(spark: SparkSession, lat_step: float, lon_step: float, closed: bool = True) -> DataFrame:
    """ilat, ilon, lat -90..90, lon from 0; closed: 360 is there as well."""
    nlat, nlon = round(180 / lat_step) + 1, round(360 / lon_step) + (1 if closed else 0)
    cells = spark.range(nlat * nlon)
    i, j = (F.col("id") / F.lit(nlon)).cast("int"), (F.col("id") % F.lit(nlon)).cast("int")
    return cells.select(F.col("id").alias("point_id"), i.alias("ilat"), j.alias("ilon"), (i * F.lit(float(lat_step)) - 90.0).alias("lat"), (j * F.lit(float(lon_step))).alias("lon"))


def synthesise_rows(lats: DataFrame, coeffs: DataFrame, nmax: int, nlon: int, first_lon: float = 0.0) -> DataFrame:
    """A full even grid by one inverse FFT for each latitude of lats (lat): rows lat, ilon, lon, epoch_id, value."""
    sets = sets_of(coeffs, nmax)
    if nlon <= 2 * nmax:
        raise ValueError(f"{nlon} longitudes don't resolve order {nmax}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, nmax):
            lat = b.column("lat").to_numpy()
            z = {e: np.zeros((len(lat), nlon // 2 + 1), complex) for e in sets}
            for m, p in columns(lat, nmax):
                for e, (c, s) in sets.items():
                    z[e][:, m] = (c[m:, m] @ p - 1j * (s[m:, m] @ p)) * np.exp(1j * m * np.radians(first_lon)) / (1 if m == 0 else 2)
            for e, of in z.items():
                rows = np.fft.irfft(of, nlon, axis=1) * nlon
                i = np.tile(np.arange(nlon, dtype=np.int32), len(lat))
                cols = [np.repeat(lat, nlon), i, first_lon + i * (360.0 / nlon), np.full(len(i), e, np.int32), rows.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["lat", "ilon", "lon", "epoch_id", "value"])

    return lats.select("lat").mapInArrow(run, "lat double, ilon int, lon double, epoch_id int, value double")


def gradient(points: DataFrame, coeffs: DataFrame, nmax: int) -> DataFrame:
    """points with by_colat = df/d(colatitude) and by_lon = df/d(lon) / sin(colatitude), defined at the poles too. Points of
    a series (epoch_id) meet their own epoch's coefficients, as in ``synthesise``."""
    sets = sets_of(coeffs, nmax)
    single = "epoch_id" not in points.columns or list(sets) == [0]
    if single and len(sets) > 1:
        raise ValueError("points without epochs meet one set of coefficients")

    def run(b: pa.RecordBatch) -> list[np.ndarray]:
        lat, lon = (b.column(x).to_numpy(zero_copy_only=False) for x in ("lat", "lon"))
        cos, sin = waves(lon, nmax)
        epoch = np.zeros(len(lat), int) if single else b.column("epoch_id").to_numpy(zero_copy_only=False)
        at = {e: np.flatnonzero(epoch == e) for e in np.unique(epoch).tolist()}
        down, across = np.zeros(len(lat)), np.zeros(len(lat))
        for m, d in slopes(lat, nmax):
            for e, rows in at.items():
                if e in sets:
                    c, s = sets[e]
                    down[rows] += (c[m:, m] @ d[:, rows]) * cos[m, rows] + (s[m:, m] @ d[:, rows]) * sin[m, rows]
        for m, q in over_sine(lat, nmax):
            for e, rows in at.items():
                if e in sets:
                    c, s = sets[e]
                    across[rows] += m * ((s[m:, m] @ q[:, rows]) * cos[m, rows] - (c[m:, m] @ q[:, rows]) * sin[m, rows])
        missing = [rows for e, rows in at.items() if e not in sets]
        if missing:
            down[np.concatenate(missing)] = across[np.concatenate(missing)] = np.nan
        return [down, across]

    out = _mapped(points, ["by_colat", "by_lon"], run, nmax)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("by_colat", "by_lon")})


def gradient_rows(lats: DataFrame, coeffs: DataFrame, nmax: int, nlon: int, first_lon: float = 0.0) -> DataFrame:
    """The gradient on a full even grid by two inverse FFTs for each latitude: lat, ilon, lon, epoch_id, by_colat, by_lon."""
    sets = sets_of(coeffs, nmax)
    if nlon <= 2 * nmax:
        raise ValueError(f"{nlon} longitudes don't resolve order {nmax}")
    turn = np.exp(1j * np.radians(first_lon) * np.arange(nmax + 1)) * np.where(np.arange(nmax + 1) == 0, 1.0, 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, nmax):
            lat = b.column("lat").to_numpy()
            z = {e: np.zeros((2, len(lat), nlon // 2 + 1), complex) for e in sets}
            for m, d in slopes(lat, nmax):
                for e, (c, s) in sets.items():
                    z[e][0][:, m] = ((c[m:, m] @ d) - 1j * (s[m:, m] @ d)) * turn[m]
            for m, q in over_sine(lat, nmax):
                for e, (c, s) in sets.items():
                    z[e][1][:, m] = m * ((s[m:, m] @ q) + 1j * (c[m:, m] @ q)) * turn[m]
            for e, both in z.items():
                i = np.tile(np.arange(nlon, dtype=np.int32), len(lat))
                cols = [np.repeat(lat, nlon), i, first_lon + i * (360.0 / nlon), np.full(len(i), e, np.int32), *[(np.fft.irfft(x, nlon, axis=1) * nlon).ravel() for x in both]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["lat", "ilon", "lon", "epoch_id", "by_colat", "by_lon"])

    return lats.select("lat").mapInArrow(run, "lat double, ilon int, lon double, epoch_id int, by_colat double, by_lon double")


def few(batches: Iterator[pa.RecordBatch], nmax: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows for which the values of one order stay within a few MB."""
    most = max(64, min(20_000, 1_000_000 // (nmax + 1)))
    for batch in batches:
        for k in range(0, batch.num_rows, most):
            yield batch.slice(k, most)


def synthesis(points: DataFrame, coeffs: DataFrame, nmax: int, source: str = "geopotential", target: str | None = None, gaussian_km: float = 0.0, love: DataFrame | None = None, out: str = "value") -> DataFrame:
    """The field at the points, smoothed and in a unit: coefficients times the filter and the target's factor by degree."""
    from orbweave.functions.units import convert
    from orbweave.operators.coeffs import smoothed

    if gaussian_km > 0:
        coeffs = smoothed(coeffs, gaussian_km, nmax)
    if target is not None:
        coeffs = convert(coeffs, source, target, love)
    return synthesise(points, coeffs, nmax, out)


def horizontal(points: DataFrame, coeffs: DataFrame, nmax: int, field_unit: str = "geopotential", love: DataFrame | None = None, scale: bool = True) -> DataFrame:
    """points with north, east, magnitude and azimuth of the horizontal displacement. With scale, coefficients are first
    turned into its potential by unit and Love numbers; abstract units and vectors are refused."""
    from orbweave.functions.geo import azimuth, magnitude
    from orbweave.functions.units import convert

    if scale:
        if field_unit in ("scalar", "unknown", "horizontal_displacement"):
            raise ValueError(f"no horizontal displacement from {field_unit!r}")
        coeffs = convert(coeffs, field_unit, "horizontal_displacement", love)
    out = gradient(points, coeffs, nmax)
    out = out.withColumn("north", -F.col("by_colat")).withColumn("east", F.col("by_lon")).drop("by_colat", "by_lon")
    return out.withColumn("magnitude", magnitude(F.col("east"), F.col("north"))).withColumn("azimuth", azimuth(F.col("east"), F.col("north")))
