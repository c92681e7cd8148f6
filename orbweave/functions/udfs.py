"""The Legendre kernels for SQL: a vectorised function and a table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from orbweave.functions.kernels import triangle, waves


@F.pandas_udf(ArrayType(DoubleType()))
def sh_legendre(lat: pd.Series, nmax: pd.Series) -> pd.Series:
    """The values of a latitude by order and degree, n from m to nmax for each m."""
    out = [None] * len(lat)
    for top in nmax.unique():
        at = np.flatnonzero((nmax == top).to_numpy())
        p = triangle(lat.to_numpy()[at], int(top))
        m, n = np.triu_indices(int(top) + 1)
        for k, row in zip(at, p[:, n, m]):
            out[k] = row
    return pd.Series(out)


@F.udtf(returnType=StructType([StructField("n", IntegerType()), StructField("m", IntegerType()), StructField("c", DoubleType()), StructField("s", DoubleType())]))
class ShBasis:
    """Rows (n, m, cosine term, sine term) of the basis at a point."""

    def eval(self, lat: float, lon: float, nmax: int) -> Iterator[tuple[int, int, float, float]]:
        p = triangle(np.array([lat]), nmax)[0]
        cos, sin = waves(np.array([lon]), nmax)
        for n in range(nmax + 1):
            for m in range(n + 1):
                yield n, m, float(p[n, m] * cos[m, 0]), float(p[n, m] * sin[m, 0])


def register(spark: SparkSession) -> None:
    spark.udf.register("sh_legendre", sh_legendre)
    spark.udtf.register("sh_basis", ShBasis)
