"""Sets of coefficients (epoch_id, n, m, c, s): arithmetic, layouts and filters by degree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["epoch_id", "n", "m"]


#: Rows of a set of coefficients or epochs that may be held on the driver.
HELD = 1 << 20


def held(rows: DataFrame) -> DataFrame:
    """A small result that several steps read, computed once: up to HELD rows as a local table, beyond that persisted."""
    table = rows.limit(HELD + 1).toArrow()
    return rows.persist() if table.num_rows > HELD else rows.sparkSession.createDataFrame(table, rows.schema)


def spine(spark: SparkSession, nmax: int) -> DataFrame:
    """All (n, m) with m <= n <= nmax."""
    return spark.range(nmax + 1).select(F.col("id").cast("int").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("m"))


def truncate(coeffs: DataFrame, nmax: int) -> DataFrame:
    """Degrees up to nmax, missing ones as zeros."""
    full = coeffs.select("epoch_id").distinct().select("epoch_id", F.explode(F.sequence(F.lit(0), F.lit(nmax))).alias("n"))
    full = full.select("epoch_id", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("m"))
    return full.join(coeffs, KEYS, "left").select(*KEYS, F.coalesce("c", F.lit(0.0)).alias("c"), F.coalesce("s", F.lit(0.0)).alias("s"))


def require_same_epochs(a: DataFrame, b: DataFrame) -> None:
    x, y = a.select("epoch_id").distinct(), b.select("epoch_id").distinct()
    if x.exceptAll(y).unionByName(y.exceptAll(x)).take(1):
        raise ValueError("the series have different epochs")


def combine(a: DataFrame, b: DataFrame, sign: int = 1, check: bool = True) -> DataFrame:
    """a + sign * b; where one has no such degree it counts as zero. A single epoch 0 on one side meets every epoch of
    the other (check=False)."""
    if check:
        require_same_epochs(a, b)
    right = b.withColumnsRenamed({"c": "_c", "s": "_s"})
    out = a.join(right, KEYS, "full_outer")
    zero = F.lit(0.0)
    return out.select(*KEYS, *[(F.coalesce(x, zero) + F.lit(float(sign)) * F.coalesce(f"_{x}", zero)).alias(x) for x in ("c", "s")])


def less_single(series: DataFrame, single: DataFrame, sign: int = -1) -> DataFrame:
    """series + sign * single, the one set meeting all epochs."""
    right = single.select("n", "m", F.col("c").alias("_c"), F.col("s").alias("_s"))
    out = series.join(right, ["n", "m"], "left")
    return out.select(*KEYS, *[(F.col(x) + F.lit(float(sign)) * F.coalesce(f"_{x}", F.lit(0.0))).alias(x) for x in ("c", "s")])


def scaled(coeffs: DataFrame, by: float | Column) -> DataFrame:
    f = F.lit(float(by)) if isinstance(by, (int, float)) else by
    return coeffs.withColumn("c", F.col("c") * f).withColumn("s", F.col("s") * f)


def without_mean(coeffs: DataFrame) -> DataFrame:
    """c of degree 0 set to 0."""
    return coeffs.withColumn("c", F.when((F.col("n") == 0) & (F.col("m") == 0), F.lit(0.0)).otherwise(F.col("c")))


#: Fixed values of the filter: the sphere's radius, and how many nodes integrate its kernel at least.
FILTER_RADIUS_KM = 6378.1363
FILTER_NODES = 501


def gaussian(radius_km: float, nmax: int, method: str = "glq", nodes: int | None = None) -> np.ndarray:
    """Weights by degree of the isotropic Gaussian filter that falls to a half at a radius; ones for a radius of 0. glq
    integrates the kernel, frc runs its recurrence upwards, which loses accuracy for wide filters."""
    ways = {"glq": lambda b: _by_integral(b, nmax, nodes), "frc": lambda b: _by_recurrence(b, nmax)}
    if method not in ways:
        raise ValueError(f"unknown method {method!r}")
    return ways[method](np.log(2.0) / (1.0 - np.cos(radius_km / FILTER_RADIUS_KM))) if radius_km > 0 else np.ones(nmax + 1)


def _by_integral(b: float, nmax: int, nodes: int | None) -> np.ndarray:
    """Moments of exp(-b (1 - x)) against the Legendre polynomials, relative to the first."""
    x, g = np.polynomial.legendre.leggauss((nodes or max(FILTER_NODES, 2 * nmax + 51)) | 1)
    moments = np.polynomial.legendre.legvander(x, nmax).T @ (g * np.exp(b * (x - 1)))
    return moments / moments[0]


def _by_recurrence(b: float, nmax: int) -> np.ndarray:
    w = np.ones(nmax + 2)
    w[1] = 1 / np.tanh(b) - 1 / b
    for n in range(2, nmax + 1):
        w[n] = w[n - 2] - (2 * n - 1) / b * w[n - 1]
    return w[: nmax + 1]


def degree_table(spark: SparkSession, w: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in enumerate(w)], "n int, w double")


def filtered(coeffs: DataFrame, table: DataFrame) -> DataFrame:
    """Every coefficient times its degree's w; degrees without one are refused."""
    out = coeffs.join(table.select("n", F.col("w").alias("_w")), "n", "left")
    bad = F.raise_error(F.concat(F.lit("no weight for degree "), F.col("n").cast("string"))).cast("double")
    w = F.coalesce("_w", bad)
    return out.select(*KEYS, (F.col("c") * w).alias("c"), (F.col("s") * w).alias("s"))


def smoothed(coeffs: DataFrame, radius_km: float, nmax: int, method: str = "glq") -> DataFrame:
    return filtered(coeffs, degree_table(coeffs.sparkSession, gaussian(radius_km, nmax, method)))


def flat(coeffs: DataFrame, nmax: int) -> DataFrame:
    """epoch_id, k, part, n, m, v: all c by order and degree, then the s of m > 0; k from 0."""
    place = F.col("m") * F.lit(nmax + 1) - (F.col("m") * (F.col("m") - 1) / 2).cast("int") + F.col("n") - F.col("m")
    half = (nmax + 1) * (nmax + 2) // 2
    c = coeffs.select("epoch_id", place.alias("k"), F.lit("c").alias("part"), "n", "m", F.col("c").alias("v"))
    s = coeffs.where("m > 0").select("epoch_id", (place + F.lit(half - nmax - 1)).alias("k"), F.lit("s").alias("part"), "n", "m", F.col("s").alias("v"))
    return c.unionByName(s)


def from_flat(rows: DataFrame) -> DataFrame:
    v = lambda part: F.coalesce(F.max(F.when(F.col("part") == part, F.col("v"))), F.lit(0.0))
    return rows.groupBy(*KEYS).agg(v("c").alias("c"), v("s").alias("s"))


def outer_triangle(coeffs: DataFrame, nmax: int) -> DataFrame:
    """epoch_id, k, v: the exchange layout of 2 * NC rows, all c and then all s, by order and degree."""
    place = F.col("m") * F.lit(nmax + 1) - (F.col("m") * (F.col("m") - 1) / 2).cast("int") + F.col("n") - F.col("m")
    half = (nmax + 1) * (nmax + 2) // 2
    return coeffs.select("epoch_id", place.alias("k"), F.col("c").alias("v")).unionByName(coeffs.select("epoch_id", (place + half).alias("k"), F.col("s").alias("v")))


def missing_epochs(coeffs: DataFrame) -> DataFrame:
    """Epochs none of whose c is finite."""
    ok = F.col("c").isNotNull() & ~F.isnan("c") & (F.abs("c") < float("inf"))
    return coeffs.groupBy("epoch_id").agg(F.count_if(ok).alias("n")).where("n = 0").select("epoch_id")
