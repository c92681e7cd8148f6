"""Spectra by degree and what they say about the degree to stop at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.geo import resolution_km

POWER = "c * c + s * s"


def degree_rms(coeffs: DataFrame, by_epoch: bool = False) -> DataFrame:
    """n, rms over the 2(n+1) slots of a degree, s of m = 0 counted, and rms_filled over the 2n+1 real ones."""
    keys = ["epoch_id", "n"] if by_epoch else ["n"]
    epochs = F.lit(1) if by_epoch else F.countDistinct("epoch_id")
    out = coeffs.groupBy(*keys).agg(F.sum(F.expr(POWER)).alias("p"), epochs.alias("t"))
    return out.select(*keys, F.sqrt(F.col("p") / (2.0 * (F.col("n") + 1) * F.col("t"))).alias("rms"), F.sqrt(F.col("p") / ((2.0 * F.col("n") + 1) * F.col("t"))).alias("rms_filled"))


def degree_power(coeffs: DataFrame) -> DataFrame:
    """n, power: the sum over orders and epochs."""
    return coeffs.groupBy("n").agg(F.sum(F.expr(POWER)).alias("power"))


def truncation_table(coeffs: DataFrame) -> DataFrame:
    """n, power, retained (share of all power up to n), error (of stopping there), resolution_km. One row a degree."""
    up = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    p = degree_power(coeffs)
    kept = F.sum("power").over(up) / F.sum("power").over(Window.partitionBy())
    out = p.withColumn("retained", F.coalesce(kept, F.lit(1.0)))
    return out.select("n", "power", "retained", F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("retained"))).alias("error"), resolution_km(F.col("n")).alias("resolution_km"))


def degree_for(coeffs: DataFrame, tolerance: float) -> DataFrame:
    """One row: nmax, the first degree that retains 1 - tolerance squared of the power."""
    return truncation_table(coeffs).agg(F.min(F.when(F.col("retained") >= 1.0 - tolerance**2, F.col("n"))).alias("nmax"))


def diagnose(coeffs: DataFrame, points: int, coverage: float, tolerance: float = 0.01) -> DataFrame:
    """One row: sampling_nmax (what the points allow; null where coverage is below 0.001), power_nmax, shape (flat, red
    or neither, by largest to mean power of the degrees from 1 on)."""
    table = truncation_table(coeffs)
    ratio = F.max(F.when(F.col("n") > 0, F.col("power"))) / F.avg(F.when(F.col("n") > 0, F.col("power")))
    row = table.agg(F.min(F.when(F.col("retained") >= 1.0 - tolerance**2, F.col("n"))).alias("power_nmax"), ratio.alias("ratio"))
    limit = max(0, int((points / (coverage * 2.0)) ** 0.5) - 1) if coverage >= 1e-3 else None
    shape = F.when(F.col("ratio") < 3, "flat").when(F.col("ratio") > 20, "red").otherwise("neither")
    return row.select(F.lit(limit).cast("int").alias("sampling_nmax"), "power_nmax", shape.alias("shape"))


def describe(coeffs: DataFrame, points: int, coverage: float, tolerance: float = 0.01) -> str:
    """The three limits of the degree, as text: what truncation loses, what the points allow, and how many degrees of
    freedom the region holds."""
    table = truncation_table(coeffs).orderBy("n").collect()
    row, top = diagnose(coeffs, points, coverage, tolerance).first(), table[-1]["n"]
    out = ["degree  kept power  error       half wave (km)"]
    out += [f"{r['n']:>6}  {r['retained']:>9.4%}  {r['error']:<10.4e}  {r['resolution_km']:.1f}" for r in table]
    out.append(f"an error of {tolerance:.2%} needs degree {row['power_nmax']}" + (", the highest here: the field may reach further" if row["power_nmax"] == top else ""))
    out.append("the points say nothing of the degree" if row["sampling_nmax"] is None else f"{points} points on {coverage:.4g} of the sphere allow degree {row['sampling_nmax']}")
    if coverage < 0.999:
        shannon = (top + 1) ** 2 * coverage
        out.append(f"the region holds {shannon:.4g} of the {(top + 1) ** 2} unknowns; one is reached at degree {max(0, round(coverage**-0.5 - 1)) if coverage > 0 else 'none'}")
    out.append({"flat": "the spectrum is flat: truncation loses evenly", "red": "the spectrum falls steeply: low degrees carry the field"}.get(row["shape"], "the spectrum is neither flat nor steep"))
    return "\n".join(out)


def warnings(row: dict) -> list[str]:
    """Remarks on one report row with the keys coverage, method, gram_deviation, c00, dc_mean, residual_rms, data_rms,
    condition_number, n_points, nmax; missing ones are passed over."""
    out, get = [], row.get
    size = (get("nmax", 0) + 1) ** 2
    cov = get("coverage")
    if cov is not None and abs(cov - 1) > 1e-3 and cov < 0.999 and get("method") != "slepian":
        out.append(f"the points cover {cov:.4g} of the sphere; coefficients describe the field times the region")
    if (get("gram_deviation") or 0) > 1e-2:
        out.append("the weights alias between coefficients")
    if get("dc_mean") and get("c00") is not None and abs(get("c00") - get("dc_mean")) / abs(get("dc_mean")) > 0.1:
        out.append("the degree 0 coefficient is off the weighted mean")
    if cov is not None and cov < 0.999 and get("method") in ("wlsq", "cg", "iterative") and get("data_rms") and (get("residual_rms") or 0) / get("data_rms") < 1e-3:
        out.append("the fit on a part of the sphere is too close to be a field")
    if (get("condition_number") or 0) > 1e8:
        out.append("the equations are ill-conditioned")
    if get("n_points") and get("n_points") / size < 2:
        out.append("fewer than two points for each unknown")
    if cov is not None and cov < 0.5:
        out.append("the Shannon number is less than half of the unknowns")
    return out
