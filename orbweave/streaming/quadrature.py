"""Quadrature over event time. The sums are additive, so windows of a stream need no state but them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.geo import FOUR_PI
from orbweave.operators.blocks import analysed, blocks_in
from orbweave.sources.storage import new_dir


def low_basis(lat: Column, lon: Column) -> list[tuple[int, int, Column, Column]]:
    """(n, m, cosine term, sine term) of degrees 0 to 2 in closed form."""
    t, u = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    p = {(0, 0): F.lit(1.0), (1, 0): F.lit(3.0**0.5) * t, (1, 1): F.lit(3.0**0.5) * u, (2, 0): F.lit(5.0**0.5 / 2) * (3.0 * t * t - 1.0), (2, 1): F.lit(15.0**0.5) * t * u, (2, 2): F.lit(15.0**0.5 / 2) * u * u}
    return [(n, m, v * F.cos(F.radians(lon) * m), v * F.sin(F.radians(lon) * m)) for (n, m), v in p.items()]


def low_degrees(points: DataFrame, by: list[str]) -> DataFrame:
    """by..., n, m, c, s for n <= 2, all in one pass: points (lat, lon, value, w)."""
    basis = low_basis(F.col("lat"), F.col("lon"))
    sums = [F.sum(F.col("w") * F.col("value") * x) / F.lit(FOUR_PI) for _, _, c, s in basis for x in (c, s)]
    row = points.groupBy(*by).agg(*[x.alias(f"_{k}") for k, x in enumerate(sums)])
    parts = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m"), F.col(f"_{2 * k}").alias("c"), F.col(f"_{2 * k + 1}").alias("s")) for k, (n, m, _, _) in enumerate(basis)])
    return row.select(*by, F.explode(parts).alias("x")).select(*by, "x.n", "x.m", "x.c", "x.s")


def windowed(stream: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """Coefficients of degrees 0 to 2 for each window of event time; rows later than ``late`` are left out."""
    basis = low_basis(F.col("lat"), F.col("lon"))
    sums = [(F.sum(F.col("w") * F.col("value") * x) / F.lit(FOUR_PI)).alias(f"_{k}") for k, x in enumerate(x for _, _, c, s in basis for x in (c, s))]
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("win")).agg(*sums)
    parts = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m"), F.col(f"_{2 * k}").alias("c"), F.col(f"_{2 * k + 1}").alias("s")) for k, (n, m, _, _) in enumerate(basis)])
    return rows.select(F.col("win.start").alias("start"), F.explode(parts).alias("x")).select("start", "x.n", "x.m", "x.c", "x.s")


def windowed_degrees(stream: DataFrame, nmax: int, width: int, late: str, ts: str = "ts") -> DataFrame:
    """start, n, m, c, s: coefficients up to any degree for each window of ``width`` seconds of event time. What a task has of a
    window goes through the Arrow kernel at once, so a micro-batch adds a row for each window, degree and order to the
    state, whatever its number of points. Windows that end ``late`` before the latest window's start are closed: what comes
    for them later is left out. Rows with a null or NaN among ts, lat, lon, value and w are left out."""
    n, m = np.tril_indices(nmax + 1)
    names = ["window", "n", "m", "c", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_in(batches):
            sums = analysed(block, nmax)[:, n, m]
            many = len(block.epochs)
            cols = [np.repeat(block.epochs, len(n)), np.tile(n.astype(np.int32), many), np.tile(m.astype(np.int32), many), sums[0].T.ravel(), sums[1].T.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

    doubles = [F.col(c).cast("double").alias(c) for c in ("lat", "lon", "w", "value")]
    number = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(width * 1_000_000)).cast("long").alias("epoch_id")
    ok = F.col("epoch_id").isNotNull()
    for c in ("lat", "lon", "w", "value"):
        ok &= F.col(c).isNotNull() & ~F.isnan(c)
    parts = stream.select(*doubles, number).where(ok).mapInArrow(run, "window long, n int, m int, c double, s double")
    parts = parts.select(F.timestamp_micros(F.col("window") * F.lit(width * 1_000_000)).alias("at"), "n", "m", "c", "s").withWatermark("at", late)
    sums = parts.groupBy(F.window("at", f"{width} seconds").alias("win"), "n", "m").agg((F.sum("c") / F.lit(FOUR_PI)).alias("c"), (F.sum("s") / F.lit(FOUR_PI)).alias("s"))
    return sums.select(F.col("win.start").alias("start"), "n", "m", "c", F.when(F.col("m") == 0, F.lit(0.0)).otherwise(F.col("s")).alias("s"))


def drained(spark: SparkSession, stream: DataFrame, name: str = "windows", checkpoint: str | None = None) -> DataFrame:
    """What a stream of windows has come to once all that is there has been read: each micro-batch replaces the whole table,
    so the result is the same after a restart from the checkpoint."""
    out = new_dir(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        seen.append(number)

    seen: list[int] = []
    job = stream.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{out}-state").foreachBatch(put)
    job.start().awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/{max(seen)}")
