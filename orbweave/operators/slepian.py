"""Slepian functions: the band-limited functions that are most concentrated where the points are."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.geo import FOUR_PI
from orbweave.functions.kernels import ordinals
from orbweave.operators import analysis, krylov
from orbweave.operators.analysis import Normal, normal, normals, to_coeffs, with_epoch
from orbweave.sources.storage import discard


@dataclass
class Basis:
    """tapers: unknowns x functions, by falling share of their power in the region (values)."""

    nmax: int
    tapers: np.ndarray
    values: np.ndarray
    shannon: float

    def usable(self, least: float = 0.5) -> int:
        return int((self.values >= least).sum())

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """eigs (alpha, lambda) and tapers (alpha, part, n, m, v)."""
        names = ordinals(self.nmax)
        eigs = spark.createDataFrame([(a, float(v)) for a, v in enumerate(self.values)], "alpha int, lambda double")
        rows = [(a, *names[k], float(self.tapers[k, a])) for a in range(self.tapers.shape[1]) for k in range(len(names))]
        return eigs, spark.createDataFrame(rows, "alpha int, part string, n int, m int, v double")


def basis(weighted: DataFrame, nmax: int, tapers: int | None = None) -> Basis:
    """From the completeness matrix of the region's points, which is its concentration matrix. The epochs of a series must
    have the same points. Beyond LARGEST unknowns the matrix is not formed: the best ``tapers`` functions, by default as many
    as the Shannon number and a tenth more, come from passes over stored blocks of the points."""
    if (nmax + 1) ** 2 <= analysis.LARGEST:
        return _of(normal(weighted, nmax, rhs=False), tapers)
    if len(analysis.point_sets(weighted)) > 1:
        raise ValueError("the epochs have different sets of points; take one of them")
    one = with_epoch(weighted).where(F.col("epoch_id") == with_epoch(weighted).agg(F.min("epoch_id")).first()[0])
    points = analysis.held_blocks(one.withColumn("value", F.lit(0.0)))
    area = points.agg(F.sum(F.aggregate("w", F.lit(0.0), lambda a, x: a + x))).first()[0] or 0.0
    shannon = (nmax + 1) ** 2 * area / FOUR_PI
    values, functions = krylov.concentrated(points, nmax, tapers or int(1.1 * shannon) + 2, shannon)
    discard(points)
    return Basis(nmax, functions, np.clip(values, 0, None), shannon)


def _of(eq: Normal, tapers: int | None) -> Basis:
    lam, v = np.linalg.eigh(eq.matrix / FOUR_PI)
    keep = np.argsort(-lam)[: tapers or len(lam)]
    return Basis(eq.nmax, v[:, keep], np.clip(lam[keep], 0, None), float(np.trace(eq.matrix) / FOUR_PI))


def analyse(weighted: DataFrame, nmax: int, least: float = 0.5, tapers: int | None = None) -> DataFrame:
    """coeffs of the part of the field in the functions with more than this share in the region. Epochs with other points
    have functions of their own."""
    if (nmax + 1) ** 2 > analysis.LARGEST:
        b = basis(weighted, nmax, tapers)
        use = b.values > least
        t, lam = b.tapers[:, use], b.values[use]
        rhs = analysis.flat(analysis.quadrature(weighted, nmax), nmax)
        return to_coeffs(weighted.sparkSession, nmax, {e: t @ ((t.T @ r) / lam) for e, r in rhs.items()})
    solved = {}
    for eq in normals(weighted, nmax):
        b = _of(eq, tapers)
        use = b.values > least
        t, lam = b.tapers[:, use], b.values[use]
        solved |= {e: t @ ((t.T @ r) / (FOUR_PI * lam)) for e, r in eq.rhs.items()}
    return to_coeffs(weighted.sparkSession, nmax, solved)
