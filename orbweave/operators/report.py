"""What an analysis says about itself: one row for a set, one row an epoch for a series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.geo import FOUR_PI, MEAN_RADIUS_KM
from orbweave.operators import analysis, spectrum
from orbweave.operators.coeffs import held
from orbweave.operators.synthesis import sets_of
from orbweave.operators.timeseries import outliers
from orbweave.sources.storage import discard


def report_row(weighted: DataFrame, coeffs: DataFrame, nmax: int, method: str, rule: str = "", extra: dict | None = None) -> dict:
    """The figures of one analysis, of a series those of its first epoch, and its warnings. gram_checked says what of the
    completeness matrix gram_deviation is from. Lazy coefficients are computed once, and the points are looked at once more."""
    size, points, sets = (nmax + 1) ** 2, analysis.held_blocks(weighted), sets_of(coeffs, nmax)
    r = analysis.residuals(points, sets, nmax).orderBy("epoch_id").first().asDict()
    c00 = float(sets[min(sets)][0, 0, 0])
    coverage = r["weight_sum"] / FOUR_PI
    out = {
        "method": method, "weight_rule": rule, "n_points": r["n_points"], "nmax": nmax, "ncoef": size, "weight_sum": r["weight_sum"], "coverage": coverage,
        "overdetermination": r["n_points"] / size, "shannon": size * coverage, "residual_rms": r["residual_rms"], "residual_rms_weighted": r["residual_rms_weighted"],
        "data_rms": r["data_rms"], "dc_mean": r["dc_mean"], "c00": c00, "fit_rmse_rel": r["residual_rms"] / r["data_rms"] if r["data_rms"] else None,
        "lmax_recommended": max(0, int((r["n_points"] / (coverage * 2)) ** 0.5) - 1) if coverage > 0 else None, "resolution_km": np.pi * MEAN_RADIUS_KM / nmax if nmax else float("inf"),
    }
    out["gram_deviation"], out["gram_checked"] = analysis.checked_deviation(points, nmax)
    discard(points)
    out |= extra or {}
    return out | {"warnings": spectrum.warnings(out)}


def series_report(weighted: DataFrame, coeffs: DataFrame, nmax: int) -> DataFrame:
    """epoch_id, n_points, data_rms, c00, dc_mean, coverage, residual_rms, fit_rmse_rel, z and outlier (of c00)."""
    sets = sets_of(coeffs, nmax)  # lazy coefficients are computed once
    r = held(analysis.residuals(weighted, sets, nmax))  # a row an epoch, which outliers looks at several times
    c00 = weighted.sparkSession.createDataFrame([(e, float(x[0, 0, 0])) for e, x in sets.items()], "epoch_id int, c00 double")
    out = r.join(c00, "epoch_id").select(
        "epoch_id", "n_points", "data_rms", "c00", "dc_mean", (F.col("weight_sum") / F.lit(FOUR_PI)).alias("coverage"), "residual_rms",
        F.when(F.col("data_rms") > 0, F.col("residual_rms") / F.col("data_rms")).alias("fit_rmse_rel"),
    )
    return outliers(out, "c00")
