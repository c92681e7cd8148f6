"""python -m orbweave COMMAND ...: the operators on files. Tables are Parquet folders unless a command reads text.

Exit codes: 0 done, 1 an error inside, 2 a wrong option, file or value, 130 interrupted.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions import geo, units
from orbweave.functions.kernels import ordinals
from orbweave.operators import analysis, coeffs, report, spectrum, synthesis, timeseries, weights
from orbweave.sources import arrays, readers, writers


def points_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    sigma = getattr(a, "sigma_col", None)
    if a.input.endswith(".grd"):
        p = readers.read_surfer(spark, a.input)
        return p.withColumn("point_id", F.xxhash64("ilat", "ilon"))
    p = readers.read_points(spark, a.input, sigma=sigma)
    if readers.looks_tidy(p.where("epoch_id = 0")):
        print("warning: most rows repeat the coordinates of others, as a table with a row for each time does; they count as points", file=sys.stderr)
    return p


def weighed(points: DataFrame, spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """points with weights by the rule, or those of a file for the rule user: its last column, row by row by place."""
    if a.rule != "user":
        return weights.weigh(points, a.rule, getattr(a, "normalise", "auto"))
    if not getattr(a, "weights", None):
        raise ValueError("--rule user needs --weights FILE")
    w = readers.read_points(spark, a.weights, value=-1).groupBy("lat", "lon").agg(F.first("value").alias("w"))
    table = points.select("point_id", "lat", "lon").distinct().join(w, ["lat", "lon"]).select("point_id", "w")
    return weights.weigh(points, "user", getattr(a, "normalise", "auto"), user=table)


def love_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    return readers.read_love(spark, a.love) if getattr(a, "love", None) else None


def coeffs_of(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".npy", ".npz")):
        return arrays.read_coeff_arrays(spark, path)
    return readers.read_coeffs(spark, path) if path.endswith((".gfc", ".csv", ".sh", ".txt", ".dat")) else spark.read.parquet(path)


def top(x: DataFrame) -> int:
    return x.agg(F.max("n")).first()[0]


def epochs_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def prepared(x: DataFrame, a: argparse.Namespace) -> DataFrame:
    """A series ready for products: mean and degree 0 off, smoothed, in the unit asked for."""
    if a.remove_time_mean:
        x = timeseries.anomaly(x)
    if a.drop_c00:
        x = coeffs.without_mean(x)
    if a.gaussian_km:
        x = coeffs.smoothed(x, a.gaussian_km, top(x))
    x = units.convert(x, a.field_unit, a.target_unit or a.field_unit, love_of(x.sparkSession, a))
    return coeffs.scaled(x, {"m": 1.0, "mm": 1000.0}[a.out_units])


def weigh(spark, a):
    w = weighed(points_of(spark, a), spark, a)
    w.write.parquet(a.out)
    row = weights.report(w).first().asDict()
    print(writers.report_markdown(row), *weights.notes(row), sep="\n")


def analyze(spark, a):
    w = weighed(points_of(spark, a), spark, a)
    how = {"tau": a.tau, "steps": a.niter, "reg": a.reg, "alpha": a.alpha, "sigma": "sigma" if a.sigma_col else None}
    if a.method != "auto":
        how = {k: v for k, v in how.items() if k in analysis.OPTIONS.get(a.method, ())}
    a.target_unit = a.target_unit or a.field_unit
    x, method = analysis.analyse(w, a.nmax, a.method, a.longitude_fft, **how)
    x = coeffs.held(x)
    row = report.report_row(w, x, a.nmax, method, a.rule)
    row["weight_notes"] = weights.notes(weights.report(w).first().asDict())
    row |= {"field_unit": a.field_unit, "forward_formula": f"C = a / f, f = {units.formula(a.field_unit)}", "inverse_formula": f"field = C f, f = {units.formula(a.target_unit)}"}
    if a.field_unit != a.target_unit:
        units.require_convertible(a.field_unit, a.target_unit)
    writers.save(a.out, units.canonical(x, a.field_unit, love_of(spark, a)), row)
    print(writers.report_markdown(row))


def synth(spark, a):
    x = prepared(coeffs_of(spark, a.input), a)
    grid = points_of(spark, argparse.Namespace(input=a.points)) if a.points else synthesis.grid_points(spark, a.step, a.step, closed=False)
    synthesis.over_epochs(grid.drop("value", "epoch_id", "label"), x, top(x)).write.parquet(a.out)


def roundtrip(spark, a):
    draw = np.random.default_rng(a.seed)
    fall = np.array([n + 1.0 for _, n, _ in ordinals(a.nmax)]) ** 2
    truth = analysis.to_coeffs(spark, a.nmax, {0: draw.normal(size=len(fall)) / fall})
    p = geo.fibonacci(spark.range(a.npoints).withColumnRenamed("id", "point_id"), "point_id", a.npoints)
    w = weights.uniform(synthesis.synthesise(p, truth, a.nmax))
    x, method = analysis.analyse(w, a.nmax, a.method)
    d = coeffs.combine(x, truth, -1)
    d.agg(F.lit(method).alias("method"), F.sqrt(F.avg(F.col("c") * F.col("c") + F.col("s") * F.col("s"))).alias("rms_error")).show()


def glq_grid(spark, a):
    weights.glq_grid(spark, a.nmax).write.parquet(a.out)


def info(spark, a):
    x = coeffs_of(spark, a.input)
    spectrum.degree_rms(x, by_epoch=True).orderBy("epoch_id", "n").show(200)


def nmax(spark, a):
    x = coeffs_of(spark, a.input)
    print(spectrum.describe(x, a.npoints, a.coverage, a.tol))


def series_read(spark, a):
    keep = {k: v for k, v in (("product", a.product), ("mission", a.mission), ("center", a.center), ("rl", a.rl)) if v}
    paths = readers.read_manifest(spark, a.input) if a.input.endswith(".txt") else a.input
    x, e = readers.read_series(spark, paths, a.nmax, a.strict_nmax, a.epoch_from, a.on_duplicate, a.sort, a.on_missing, **keep)
    x.write.parquet(f"{a.out}/coeffs")
    e.write.parquet(f"{a.out}/epochs")


def analyze_series(spark, a):
    p = points_of(spark, a)
    if a.epochs:
        first, _, end = a.epochs.partition(":")
        p = p.where(F.col("epoch_id") >= int(first or 0))
        p = p.where(F.col("epoch_id") < int(end)) if end else p
    w = weighed(p, spark, a)
    for k, part in enumerate(in_chunks(w, a.epoch_chunk)):
        if a.method == "quadrature":
            x, plan = analysis.quadrature_planned(part, a.nmax, a.longitude_fft)
            if k == 0:
                print(f"longitudes: {plan.path}, {plan.reason}")
        else:
            x = analysis.analyse(part, a.nmax, a.method, a.longitude_fft)[0]
        if a.gaussian_km:
            x = coeffs.smoothed(x, a.gaussian_km, a.nmax)
        units.canonical(x, a.field_unit, love_of(spark, a)).write.mode("append" if k else "error").parquet(f"{a.out}/coeffs")
    if a.report_fit:
        x = spark.read.parquet(f"{a.out}/coeffs")
        fitted = units.convert(x, "geopotential", a.field_unit, love_of(spark, a)) if a.field_unit not in units.ABSTRACT else x
        report.series_report(w, fitted, a.nmax).write.csv(f"{a.out}/epochs", header=True)


def in_chunks(w: DataFrame, many: int | None) -> Iterator[DataFrame]:
    """The points of ``many`` epochs at a time, which bounds what is solved at once; all of them without a number."""
    if not many:
        yield w
        return
    epochs = sorted(r[0] for r in w.select("epoch_id").distinct().limit(analysis.EPOCHS + 1).collect())
    if many < 1 or len(epochs) > analysis.EPOCHS:
        raise ValueError(f"a chunk has an epoch at least, and a call {analysis.EPOCHS} at most")
    for k in range(0, len(epochs), many):
        yield w.where(F.col("epoch_id").between(epochs[k], epochs[min(k + many, len(epochs)) - 1]))


def timefit(spark, a):
    f = timeseries.fit(coeffs_of(spark, f"{a.input}/coeffs"), epochs_of(spark, f"{a.input}/epochs"), a.poly_order, a.periods)
    f.frame.write.parquet(a.out)
    print(f.summary())


def time_filter(spark, a):
    timeseries.gaussian_in_time(coeffs_of(spark, f"{a.input}/coeffs"), epochs_of(spark, f"{a.input}/epochs"), a.sigma, a.truncate).write.parquet(a.out)


def series_grid(spark, a):
    x = prepared(coeffs_of(spark, f"{a.input}/coeffs"), a)
    writers.write_field(synthesis.over_epochs(synthesis.grid_points(spark, a.step, a.step, closed=False), x, top(x)), a.out)


def series_points(spark, a):
    x = prepared(coeffs_of(spark, f"{a.input}/coeffs"), a)
    p = points_of(spark, argparse.Namespace(input=a.points)).select("point_id", "lat", "lon").distinct()
    writers.write_points(synthesis.over_epochs(p, x, top(x)), a.out)


def basin_average(spark, a):
    x = prepared(coeffs_of(spark, f"{a.input}/coeffs"), a)
    p = points_of(spark, argparse.Namespace(input=a.points)).select("point_id", "lat", "lon").distinct()
    p = weighed(p, spark, a).withColumn("basin", F.lit("basin"))
    timeseries.basin_average(synthesis.over_epochs(p, x, top(x))).orderBy("epoch_id").write.csv(a.out, header=True)


def parser() -> argparse.ArgumentParser:
    top_level = argparse.ArgumentParser(prog="orbweave")
    sub = top_level.add_subparsers(required=True)

    def command(name, run, *options, out=True, source=True):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        if source:
            p.add_argument("input")
        if out:
            p.add_argument("--out", required=True)
        for flag, how in options:
            p.add_argument(flag, **how)

    n, rule = ("--nmax", {"type": int, "default": 20}), ("--rule", {"default": "auto", "choices": weights.RULES})
    given, love, longitude = ("--weights", {}), ("--love", {}), ("--longitude-fft", {"default": "auto", "choices": ("auto", "fft", "direct")})
    in_unit, out_unit = ("--field-unit", {"default": "scalar", "choices": units.UNITS}), ("--target-unit", {"choices": units.UNITS})
    unit = [in_unit, out_unit, love, ("--out-units", {"default": "m", "choices": ("m", "mm")}), ("--gaussian-km", {"type": float, "default": 0.0}), ("--drop-c00", {"action": "store_true"}), ("--remove-time-mean", {"action": "store_true"})]
    step, points = ("--step", {"type": float, "default": 1.0}), ("--points", {})
    command("weights", weigh, rule, given, ("--normalise", {"default": "auto"}))
    command("analyze", analyze, n, rule, given, love, longitude, in_unit, out_unit, ("--method", {"default": "auto"}), ("--tau", {"type": float}), ("--niter", {"type": int}), ("--reg", {}), ("--alpha", {"type": float}), ("--sigma-col", {}))
    command("synth", synth, step, points, *unit)
    command("roundtrip", roundtrip, n, ("--npoints", {"type": int, "default": 3000}), ("--seed", {"type": int, "default": 0}), ("--method", {"default": "auto"}), out=False, source=False)
    command("glq-grid", glq_grid, n, source=False)
    command("info", info, out=False)
    command("nmax", nmax, ("--npoints", {"type": int, "required": True}), ("--coverage", {"type": float, "default": 1.0}), ("--tol", {"type": float, "default": 0.01}), out=False)
    command("series-read", series_read, ("--nmax", {"type": int}), ("--product", {"default": "GSM"}), ("--mission", {}), ("--center", {}), ("--rl", {}), ("--strict-nmax", {"action": "store_true"}), ("--epoch-from", {"default": "auto"}), ("--on-duplicate", {"default": "error"}), ("--sort", {"default": "time", "choices": ("time", "name", "none")}), ("--on-missing", {"default": "warn", "choices": ("ignore", "warn", "error")}))
    command("analyze-series", analyze_series, n, rule, given, love, longitude, in_unit, ("--method", {"default": "quadrature"}), ("--epochs", {}), ("--epoch-chunk", {"type": int}), ("--report-fit", {"action": "store_true"}), ("--gaussian-km", {"type": float, "default": 0.0}))
    command("timefit", timefit, ("--poly-order", {"type": int, "default": 1}), ("--periods", {"type": float, "nargs": "*", "default": [1.0]}))
    command("time-filter", time_filter, ("--sigma", {"type": float, "required": True}), ("--truncate", {"type": float, "default": 4.0}))
    command("series-grid", series_grid, step, *unit)
    command("series-points", series_points, ("--points", {"required": True}), *unit)
    command("basin-average", basin_average, ("--points", {"required": True}), rule, given, *unit)
    return top_level


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        a.run(spark, a)
    except KeyboardInterrupt:
        return 130
    except (ValueError, FileNotFoundError, AnalysisException) as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:  # noqa: BLE001  said in one line, as all the others
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
