"""Physical units of coefficients: factors by degree as column expressions, and the refusals.

Coefficients are dimensionless geopotential ones; a factor by degree turns them into a unit's. Load Love numbers come as
columns k, h and l of an input table; none are shipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the unit definitions.
EARTH_RADIUS_M = 6378136.46
RHO_EARTH = 5517.0
RHO_WATER = 1000.0
#: The three load Love numbers k' that are known without a table.
KNOWN_K = {0: 0.0, 1: 0.02617, 2: -0.30516}
UNITS = ("scalar", "unknown", "geopotential", "geoid", "surface_density", "ewh", "radial_displacement", "horizontal_displacement")
ABSTRACT = ("scalar", "unknown")


def known_love(n: Column) -> Column:
    out = F.lit(0.0)
    for degree, k in KNOWN_K.items():
        out = F.when(n == degree, F.lit(k)).otherwise(out)
    return out


def factor(unit: str, n: Column, k: Column | None = None, h: Column | None = None, load: Column | None = None) -> Column:
    """What geopotential coefficients of degree n are multiplied with."""
    one = 1.0 + F.coalesce(k, F.lit(0.0)) if k is not None else F.lit(1.0)
    if unit == "geopotential":
        return F.lit(1.0)
    if unit == "geoid":
        return F.lit(EARTH_RADIUS_M)
    if unit == "surface_density":
        return F.lit(EARTH_RADIUS_M * RHO_EARTH / 3.0) * (2.0 * n + 1.0) / one
    if unit == "ewh":
        return F.lit(EARTH_RADIUS_M * RHO_EARTH / (3.0 * RHO_WATER)) * (2.0 * n + 1.0) / one
    if unit == "radial_displacement" and h is not None:
        return F.lit(EARTH_RADIUS_M) * F.coalesce(h, F.lit(0.0)) / one
    if unit == "horizontal_displacement" and load is not None:
        return F.lit(EARTH_RADIUS_M) * F.coalesce(load, F.lit(0.0)) / one
    raise ValueError(f"no factor by degree for {unit!r} with the Love numbers given")


def require_convertible(source: str, target: str) -> None:
    """Raises unless coefficients of one unit can become the other's."""
    for u in (source, target):
        if u not in UNITS:
            raise ValueError(f"unknown unit {u!r}")
    if source == target:
        return
    if source in ABSTRACT or target in ABSTRACT:
        raise ValueError(f"{source!r} and {target!r} have no physical relation")
    if source == "horizontal_displacement":
        raise ValueError("horizontal displacement is a vector field and can't be converted back")


#: What factors are made of, for reports.
FORMULAS = {
    "scalar": "1", "unknown": "1", "geopotential": "1", "geoid": "R", "surface_density": "R rho_e / 3 * (2n + 1) / (1 + k'_n)",
    "ewh": "R rho_e / (3 rho_w) * (2n + 1) / (1 + k'_n)", "radial_displacement": "R h'_n / (1 + k'_n)", "horizontal_displacement": "R l'_n / (1 + k'_n)",
}


def formula(unit: str) -> str:
    """A unit's factor by degree in words."""
    if unit not in FORMULAS:
        raise ValueError(f"unknown unit {unit!r}")
    return FORMULAS[unit]


def factor_table(spark: SparkSession, nmax: int, units: tuple[str, ...] = ("geoid", "surface_density", "ewh"), love: DataFrame | None = None) -> DataFrame:
    """n and a column of factors for each unit."""
    n = spark.range(nmax + 1).select(F.col("id").cast("int").alias("n"))
    for u in units:
        n = _factors(n, u, love).withColumnRenamed("_f", u)
    return n


def describe_conversion(spark: SparkSession, nmax: int = 8, love: DataFrame | None = None) -> str:
    """The factors of the common units by degree, as text."""
    rows = factor_table(spark, nmax, love=love).orderBy("n").collect()
    names = [c for c in rows[0].asDict() if c != "n"]
    return "\n".join([" ".join([f"{'n':>3}", *[f"{u:>16}" for u in names]]), *[" ".join([f"{r['n']:>3}", *[f"{r[u]:>16.6e}" for u in names]]) for r in rows]])


def _factors(rows: DataFrame, unit: str, love: DataFrame | None) -> DataFrame:
    """rows (n, ...) with _f. Degrees that a table of Love numbers doesn't have count as 0 there."""
    if unit in ABSTRACT:
        return rows.withColumn("_f", F.lit(1.0))
    if love is None:
        return rows.withColumn("_f", factor(unit, F.col("n"), known_love(F.col("n")), F.lit(0.0), F.lit(0.0)))
    named = love.select(F.col("n").alias("_n"), F.col("k").alias("_k"), F.col("h").alias("_h"), F.col("l").alias("_l"))
    joined = rows.join(named, rows["n"] == F.col("_n"), "left")
    return joined.withColumn("_f", factor(unit, F.col("n"), F.col("_k"), F.col("_h"), F.col("_l"))).drop("_n", "_k", "_h", "_l")


def canonical(coeffs: DataFrame, unit: str, love: DataFrame | None = None) -> DataFrame:
    """Coefficients of a field in a unit as geopotential ones; those of abstract units stay as they are."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    if unit in ABSTRACT or unit == "geopotential":
        return coeffs
    return convert(coeffs, unit, "geopotential", love)


def convert(coeffs: DataFrame, source: str, target: str, love: DataFrame | None = None) -> DataFrame:
    """coeffs (n, m, c, s, ...) from one unit to another, by way of geopotential. Degrees whose source factor is 0 become
    0; it is an error if they hold anything to speak of."""
    require_convertible(source, target)
    if source == target:
        return coeffs
    if source != "geopotential" and has_zeros(source):
        require_empty_degrees(coeffs, source, love)
    cols = coeffs.columns
    out = _factors(coeffs, source, love)
    for x in ("c", "s"):
        out = out.withColumn(x, F.when(F.col("_f") != 0, F.col(x) / F.col("_f")).otherwise(F.lit(0.0)))
    out = _factors(out.drop("_f"), target, love)
    for x in ("c", "s"):
        out = out.withColumn(x, F.col(x) * F.col("_f"))
    return out.select(*cols)


def has_zeros(unit: str) -> bool:
    """Whether a unit's factor can be 0 for some degree: only those of displacements can, where a Love number is."""
    return unit in ("radial_displacement", "horizontal_displacement")


def require_empty_degrees(coeffs: DataFrame, source: str, love: DataFrame | None = None, most: float = 1e-8) -> None:
    """Raises if a degree whose factor is 0 holds more than ``most`` of the RMS of all coefficients."""
    power = F.col("c") * F.col("c") + F.col("s") * F.col("s")
    row = _factors(coeffs, source, love).agg(F.sqrt(F.avg(power)).alias("rms"), F.sqrt(F.max(F.when(F.col("_f") == 0, power))).alias("lost")).first()
    if row["lost"] is not None and row["lost"] > most * (row["rms"] or 0.0):
        raise ValueError(f"degrees that {source!r} doesn't define hold {row['lost']:.3g}")
