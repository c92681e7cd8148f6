"""DataFrames to files. Parquet is the canonical form; text layouts are for exchange."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.geo import west_east
from orbweave.operators.coeffs import outer_triangle


def write_points(points: DataFrame, path: str, sep: str = ",") -> None:
    """lon, lat and a value column for each epoch, in single rows a point. More epochs than a file has columns for are an
    error."""
    if "epoch_id" in points.columns and points.select("epoch_id").distinct().count() > 1:
        wide = points.groupBy("point_id", "lon", "lat").pivot("epoch_id").agg(F.first("value"))
        names = [c for c in wide.columns if c not in ("point_id", "lon", "lat")]
        out = wide.select("lon", "lat", *[F.col(c).alias("value" if k == 0 else f"value{k}") for k, c in enumerate(names)])
    else:
        out = points.select("lon", "lat", "value")
    out.write.csv(path, header=True, sep=sep)


def require_rising(epochs: DataFrame) -> None:
    """Raises unless dates rise strictly with epoch_id."""
    before = F.lag("ts").over(Window.orderBy("epoch_id"))
    if epochs.select("ts", before.alias("b")).where("ts <= b or (ts is null and b is not null)").take(1):
        raise ValueError("the dates of a field series rise strictly from epoch to epoch")


def write_field(field: DataFrame, path: str, epochs: DataFrame | None = None) -> None:
    """Fields in the layout of gridded products: north to south, longitudes from -180, single precision, by epoch. epochs
    (epoch_id, ts) lie beside them in ``path``-epochs, and must rise strictly."""
    if epochs is not None:
        require_rising(epochs)
        epochs.write.parquet(f"{path.rstrip('/')}-epochs")
    out = field.select("epoch_id", "lat", west_east(F.col("lon")).alias("lon"), F.col("value").cast("float").alias("value"))
    out.repartition("epoch_id").sortWithinPartitions("epoch_id", F.desc("lat"), "lon").write.partitionBy("epoch_id").parquet(path)


def write_grid_csv(field: DataFrame, path: str) -> None:
    field.select("lat", "lon", "value").write.csv(path, header=True)


def surfer_text(grid: DataFrame) -> str:
    """An ASCII grid (DSAA) of one epoch (ilat, ilon, lat, lon, value); a grid is written by one process."""
    p = grid.orderBy("ilat", "ilon").toPandas()
    ny, nx = p["ilat"].max() + 1, p["ilon"].max() + 1
    rows = p["value"].to_numpy().reshape(ny, nx)
    head = ["DSAA", f"{nx} {ny}", f"{p['lon'].min():.10g} {p['lon'].max():.10g}", f"{p['lat'].min():.10g} {p['lat'].max():.10g}", f"{rows.min():.10g} {rows.max():.10g}"]
    return "\n".join(head + [" ".join(f"{v:.12g}" for v in r) for r in rows]) + "\n"


def coeff_csv_lines(coeffs: DataFrame, nmax: int) -> DataFrame:
    """k, line: rows n, m, C, S, with further pairs of columns for further epochs, by degree and order."""
    names = [r[0] for r in coeffs.select("epoch_id").distinct().orderBy("epoch_id").collect()]
    pairs = [c for k, e in enumerate(names) for c in ((f"C_t{k}", e, "c"), (f"S_t{k}", e, "s"))]
    text = lambda e, v: F.format_string("%.16e", F.coalesce(F.max(F.when(F.col("epoch_id") == e, F.col(v))), F.lit(0.0)))
    rows = coeffs.groupBy("n", "m").agg(F.concat_ws(",", *[text(e, v) for _, e, v in pairs]).alias("x"))
    head = ",".join(["n", "m", *(["C", "S"] if len(names) == 1 else [c for c, _, _ in pairs])])
    lines = rows.select((F.col("n") * (nmax + 1) + F.col("m") + 1).alias("k"), F.concat_ws(",", F.col("n").cast("string"), F.col("m").cast("string"), F.col("x")).alias("line"))
    return coeffs.sparkSession.createDataFrame([(0, head)], "k int, line string").unionByName(lines)


def triangle_lines(coeffs: DataFrame, nmax: int, labels: dict[int, str] | None = None) -> DataFrame:
    """k, line: the exchange layout, all c and then all s, a column an epoch. labels: a first line with the epochs' labels,
    behind a #."""
    if labels is not None:
        title = "# " + " ".join(labels[e].replace(" ", "_") for e in sorted(labels))
        return coeffs.sparkSession.createDataFrame([(-1, title)], "k int, line string").unionByName(triangle_lines(coeffs, nmax))
    rows = outer_triangle(coeffs, nmax).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("epoch_id", "v"))).alias("x"))
    return rows.select("k", F.array_join(F.transform("x", lambda r: F.format_string("%.16e", r["v"])), " ").alias("line"))


def gfc_lines(coeffs: DataFrame, nmax: int, epoch_id: int | None = None, meta: dict[str, object] | None = None) -> DataFrame:
    """k, line: a model file, with standard deviations where there are columns sc and ss. A series of several epochs needs
    the one to write. meta: further fields of the header, as ``unit``."""
    if epoch_id is not None:
        coeffs = coeffs.where(F.col("epoch_id") == epoch_id)
    elif coeffs.select("epoch_id").distinct().count() > 1:
        raise ValueError("a model file holds one epoch; name it")
    sigmas = {"sc", "ss"} <= set(coeffs.columns)
    form, cols = ("gfc %5d %5d %23.16e %23.16e", ["n", "m", "c", "s"]) if not sigmas else ("gfc %5d %5d %23.16e %23.16e %11.4e %11.4e", ["n", "m", "c", "s", "sc", "ss"])
    lines = coeffs.select((F.col("n") * (nmax + 1) + F.col("m") + 100).alias("k"), F.format_string(form, *cols).alias("line"))
    fields = {"product_type": "gravity_field", "max_degree": nmax, "errors": "formal" if sigmas else "no", "norm": "fully_normalized", **(meta or {})}
    head = [(k, f"{key} {value}") for k, (key, value) in enumerate(fields.items())] + [(99, "end_of_head")]
    return coeffs.sparkSession.createDataFrame(head, "k int, line string").unionByName(lines)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).sortWithinPartitions("k").select("line").write.text(path)


def report_json(row: dict) -> str:
    return json.dumps(row, default=str, indent=1)


def report_markdown(row: dict) -> str:
    return "\n".join(["| key | value |", "|-|-|", *[f"| {k} | {v} |" for k, v in row.items()]]) + "\n"


def save(path: str, coeffs: DataFrame, report: dict, field: DataFrame | None = None) -> None:
    """A folder with coefficients, report and field."""
    coeffs.write.parquet(f"{path}/coeffs")
    coeffs.sparkSession.createDataFrame([(report_json(report), report_markdown(report))], "json string, markdown string").write.parquet(f"{path}/report")
    if field is not None:
        field.write.parquet(f"{path}/field")
