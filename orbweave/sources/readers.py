"""Text formats to DataFrames. The driver looks at a file's first lines; Spark reads the rest."""

from __future__ import annotations

import math
import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions.calendar import header_period, midpoint, name_fields
from orbweave.functions.geo import wrapped

#: Fixed names that columns of points go by.
LAT_NAMES = ("lat", "latitude", "phi", "y", "纬度")
LON_NAMES = ("lon", "long", "longitude", "lng", "lambda", "x", "经度")
VALUE_NAMES = ("value", "val", "z", "data", "f", "obs", "值")
SIGMA_NAMES = ("sigma", "std", "error", "err")
BOM = "\ufeff"


def sniff(lines: list[str]) -> str:
    """The delimiter: a tab where there is one, else the most frequent of , ; |, else white space."""
    text = "\n".join(lines)
    if "\t" in text:
        return "\t"
    best = max(",;|", key=text.count)
    return best if text.count(best) else " "


def _cells(line: str, sep: str) -> list[str]:
    return line.split() if sep == " " else [x.strip().strip('"') for x in line.split(sep)]


def _number(x: str) -> bool:
    try:
        float(x)
    except ValueError:
        return False
    return True


def look_like_dates(labels: list[str]) -> bool:
    """All labels are YYYY, YYYY-MM or YYYY-MM-DD and strictly increase."""
    fit = [re.fullmatch(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?", x.strip()) for x in labels]
    keys = [tuple(int(p or 1) for p in m.groups()) for m in fit if m]
    return len(keys) == len(labels) and len(keys) > 0 and all(a < b for a, b in zip(keys, keys[1:]))


def resolve(columns: list[str], wanted: str | int | None, aliases: tuple[str, ...]) -> int | None:
    """A column by name (case aside), index from 0, or negative index from the end; without one by its aliases."""
    low = [c.lower() for c in columns]
    if wanted is None:
        return next((low.index(a) for a in aliases if a in low), None)
    if isinstance(wanted, str) and wanted.lower() in low:
        return low.index(wanted.lower())
    if isinstance(wanted, int) or re.fullmatch(r"-?\d+", str(wanted)):
        k = int(wanted)
        if -len(columns) <= k < len(columns):
            return k % len(columns)
    raise ValueError(f"no column {wanted!r} among {columns}")


def _head(spark: SparkSession, path: str, n: int = 50) -> list[str]:
    return [r[0].lstrip(BOM) for r in spark.read.text(path).limit(n).collect()]


def _rows(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Rows as arrays of fields ``x``, and the column names (made up without a header)."""
    head = [x for x in _head(spark, path) if x.strip() and not x.lstrip().startswith(("#", "%"))]
    if not head:
        raise ValueError(f"{path} holds no rows")
    sep = sniff(head)
    first = _cells(head[0], sep)
    named = not all(_number(x) for x in first if x)
    text = F.trim(F.regexp_replace("value", f"^{BOM}", ""))
    pattern = r"\s+" if sep == " " else re.escape(sep)
    rows = spark.read.text(path).select(text.alias("t")).where((F.col("t") != "") & ~F.col("t").rlike("^[#%]"))
    rows = rows.select(F.split("t", pattern).alias("x"))
    if named:
        rows = rows.where(F.array_join("x", "\x01") != F.lit("\x01".join(re.split(pattern, head[0].strip()))))
    return rows, first if named else [f"c{k}" for k in range(len(first))]


def _value(k: int) -> Column:
    return F.expr(f"try_cast(trim(both '\"' from trim(get(x, {k}))) as double)")


def read_points(spark: SparkSession, path: str, lat: str | int | None = None, lon: str | int | None = None, value: str | int | None = None, sigma: str | int | None = None) -> DataFrame:
    """point_id, lat, lon, epoch_id, label, value [, sigma]: one row for each point and epoch. point_id is a hash of what the
    row says, so that it is the same however the file is split. Columns named like dates are epochs. Without names the first three columns are lon, lat, value. Rows without finite coordinates are left out."""
    rows, names = _rows(spark, path)
    i, j = resolve(names, lat, LAT_NAMES), resolve(names, lon, LON_NAMES)
    j = 0 if j is None else j
    i = (1 if j == 0 else 0) if i is None else i
    k = resolve(names, value, VALUE_NAMES)
    s = resolve(names, sigma, SIGMA_NAMES) if sigma is not None else None
    rest = [x for x in range(len(names)) if x not in (i, j, s)]
    epochs = [x for x in rest if look_like_dates([names[x]])]
    use = epochs if value is None and len(epochs) > 1 and look_like_dates([names[x] for x in epochs]) else [k if k is not None else rest[0]]
    out = rows.select(_value(i).alias("lat"), _value(j).alias("lon"), *([_value(s).alias("sigma")] if s is not None else []), F.array(*[_value(x) for x in use]).alias("v"))
    out = out.where("lat between -90 and 90 and lon is not null and not isnan(lat) and not isnan(lon)")
    out = out.withColumn("lon", wrapped(F.col("lon")))
    # one id for each row, whatever the layout of the file: rows alike in everything are numbered
    same = Window.partitionBy("lat", "lon", "v").orderBy(F.lit(0))
    out = out.withColumn("_k", F.row_number().over(same)).withColumn("point_id", F.xxhash64("lat", "lon", F.col("v").cast("string"), "_k")).drop("_k")
    label = F.element_at(F.array(*[F.lit(names[x]) for x in use]), F.col("epoch_id") + 1)
    keep = ["point_id", "lat", "lon"] + (["sigma"] if s is not None else [])
    return out.select(*keep, F.posexplode("v").alias("epoch_id", "value")).withColumn("label", label)


def read_grid_csv(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon, value from rows with lat first; longitudes are taken to 0..360."""
    rows, names = _rows(spark, path)
    i, j = resolve(names, None, LAT_NAMES), resolve(names, None, LON_NAMES)
    i, j = (0, 1) if i is None or j is None else (i, j)
    k = next(x for x in range(len(names)) if x not in (i, j))
    return with_axes(rows.select(_value(i).alias("lat"), wrapped(_value(j)).alias("lon"), _value(k).alias("value")).where("lat is not null and lon is not null"))


def with_axes(points: DataFrame) -> DataFrame:
    """points with ilat and ilon, the places of their coordinates on ascending axes."""
    from orbweave.operators.places import ordinals

    for v, i in (("lat", "ilat"), ("lon", "ilon")):
        points = points.join(ordinals(points.select(v).distinct(), v).withColumnRenamed("at", i), v)
    return points


def read_surfer(spark: SparkSession, path: str) -> DataFrame:
    """ilat, ilon, lat, lon, value of an ASCII grid (DSAA): numbers by rows from the south."""
    text = F.regexp_replace("value", rf"^{BOM}?\s*|\s+$", "")
    x = spark.read.text(path, wholetext=True).select(F.split(text, r"\s+").alias("t"))
    if not x.where(F.get("t", F.lit(0)) == "DSAA").take(1):
        raise ValueError(f"{path} is no ASCII grid")
    number = lambda k: F.get("t", F.lit(k)).cast("double")
    nx, ny = F.get("t", F.lit(1)).cast("int"), F.get("t", F.lit(2)).cast("int")
    rows = x.select(nx.alias("nx"), ny.alias("ny"), *[number(k).alias(f"h{k}") for k in range(3, 7)], F.posexplode(F.slice("t", F.lit(10), F.size("t") - 9)).alias("k", "z"))
    i, j = (F.col("k") / F.col("nx")).cast("int"), F.col("k") % F.col("nx")
    step = lambda lo, hi, n: (F.col(hi) - F.col(lo)) / F.greatest(F.lit(1), F.col(n) - 1)
    out = rows.select(i.alias("ilat"), j.alias("ilon"), (F.col("h5") + i * step("h5", "h6", "ny")).alias("lat"), wrapped(F.col("h3") + j * step("h3", "h4", "nx")).alias("lon"), F.col("z").cast("double").alias("value"))
    return out.withColumn("value", F.when(F.col("value") < 1.70141e38, F.col("value")))


def read_gfc(spark: SparkSession, paths: str | list[str], nmax: int | None = None) -> DataFrame:
    """file, n, m, c, s [, sc, ss] of model files whose data lines start with gfc, gfct, grcof2 or grcf."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.split(F.trim(F.regexp_replace("value", f"^{BOM}", "")), r"\s+").alias("x"))
    rows = rows.where(F.lower(F.get("x", F.lit(0))).isin("gfc", "gfct", "grcof2", "grcf"))
    number = lambda k: F.expr(f"try_cast(regexp_replace(get(x, {k}), '[dD]', 'e') as double)")
    out = rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.get("x", F.lit(1)).cast("int").alias("n"), F.get("x", F.lit(2)).cast("int").alias("m"), number(3).alias("c"), number(4).alias("s"), number(5).alias("sc"), number(6).alias("ss"))
    out = out.where("n is not null and m <= n and c is not null")
    return out.where(F.col("n") <= nmax) if nmax is not None else out


def read_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, start, last (days) from the headers of model files."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.substring_index("value", "end_of_head", 1).alias("head"))
    start, last = header_period(F.col("head"))
    return text.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), start.alias("start"), last.alias("last"))


def read_meta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, key, value of the fields in headers: lines before end_of_head of model files, and lines that start with # of
    triangles, each as a name and the rest, parted by white space, a colon or an equals sign."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", BOM, "").alias("value"))
    model = F.substring_index("value", "end_of_head", 1)
    lines = F.when(F.contains("value", F.lit("end_of_head")), F.split(model, r"\r?\n")).otherwise(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x).startswith("#")))
    rows = text.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.explode(lines).alias("line"))
    form = r"^[#\s]*([A-Za-z_][\w.]*)\s*[:=\s]\s*(.+?)\s*$"
    return rows.where(F.col("line").rlike(form)).select("file", F.lower(F.regexp_extract("line", form, 1)).alias("key"), F.regexp_extract("line", form, 2).alias("value"))


def read_field_series(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(fields, epochs) as ``writers.write_field`` leaves them: epoch_id, lat, lon in 0..360, value. A filter on epoch_id
    opens the folders of these epochs alone. Without an epoch table epochs are none."""
    field = spark.read.parquet(path).select("epoch_id", "lat", wrapped(F.col("lon")).alias("lon"), F.col("value").cast("double").alias("value"))
    beside = f"{path.rstrip('/')}-epochs"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(beside)
    return field, spark.read.parquet(beside) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def read_manifest(spark: SparkSession, path: str) -> list[str]:
    """Paths listed in a text file, one a line; those that aren't absolute are taken from the list's folder."""
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    lines = [r[0].lstrip(BOM).strip() for r in spark.read.text(path).collect()]
    return [x if re.match(r"^(/|[a-z0-9]+:)", x) else f"{folder}/{x}" for x in lines if x and not x.startswith("#")]


def degree_of(rows: int) -> int:
    """nmax of a triangle with 2 * (L+1)(L+2)/2 rows."""
    n = (math.isqrt(1 + 4 * rows) - 3) // 2
    if (n + 1) * (n + 2) != rows:
        raise ValueError(f"{rows} rows are no triangle of coefficients")
    return n


def read_legacy_times(spark: SparkSession, path: str) -> DataFrame:
    """epochs of a table idx, y_start, y_end, y_mid."""
    from orbweave.operators.timeaxis import from_decimal_years

    x = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", f"^{BOM}", "")), r"[\s,]+").alias("x"))
    years = x.select((F.expr("try_cast(get(x, 0) as double)").cast("int") - 1).alias("epoch_id"), F.expr("try_cast(get(x, 3) as double)").alias("decimal_year"))
    return from_decimal_years(years.where("epoch_id is not null and decimal_year is not null"))


def read_triangle(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """epoch_id, n, m, c, s of the exchange layout: all c, then all s, by order and degree; a column an epoch. skip: lines
    of labels at the top."""
    text = F.trim(F.regexp_replace("value", f"^{BOM}", ""))
    whole = spark.read.text(path, wholetext=True).select(F.filter(F.split(text, r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike("^[#%]")).alias("t"))
    rows = whole.select(F.posexplode(F.slice("t", F.lit(skip + 1), F.greatest(F.lit(0), F.size("t") - skip))).alias("k", "x")).select("k", F.split(F.trim("x"), r"[\s,]+").alias("x"))
    nmax = degree_of(rows.count())
    half = (nmax + 1) * (nmax + 2) // 2
    spine = [(m * (nmax + 1) - m * (m - 1) // 2 + n - m, n, m) for m in range(nmax + 1) for n in range(m, nmax + 1)]
    spine = spark.createDataFrame(spine, "j int, n int, m int")
    rows = rows.select((F.col("k") % half).alias("j"), (F.col("k") >= half).alias("sine"), F.posexplode("x").alias("epoch_id", "v"))
    v = lambda sine: F.max(F.when(F.col("sine") == sine, F.col("v").cast("double")))
    return rows.join(F.broadcast(spine), "j").groupBy("epoch_id", "n", "m").agg(v(False).alias("c"), v(True).alias("s"))


def read_coeff_csv(spark: SparkSession, path: str) -> DataFrame:
    """epoch_id, n, m, c, s of rows n, m, C, S [, C, S of the next epoch ...]."""
    rows, names = _rows(spark, path)
    pairs = F.array(*[F.struct(_value(k).alias("c"), _value(k + 1).alias("s")) for k in range(2, len(names) - 1, 2)])
    out = rows.select(_value(0).cast("int").alias("n"), _value(1).cast("int").alias("m"), F.posexplode(pairs).alias("epoch_id", "p"))
    return out.select("epoch_id", "n", "m", "p.c", "p.s").where("n is not null and m <= n")


def detect_layout(spark: SparkSession, path: str) -> str:
    """gfc, csv (rows n, m, C, S) or triangle, by the first lines."""
    lines = [x.strip() for x in _head(spark, path, 200) if x.strip() and not x.lstrip().startswith(("#", "%"))]
    if any(re.match(r"(?i)(gfct?|grcof2|grcf)\s|product_type|end_of_head|earth_gravity", x) for x in lines):
        return "gfc"
    if lines:
        cells = _cells(lines[0], sniff(lines))
        if [c.lower() for c in cells[:2]] == ["n", "m"]:
            return "csv"
        rows = [_cells(x, sniff(lines)) for x in lines[:20]]
        whole = all(len(r) >= 4 and re.fullmatch(r"\d+", r[0]) and re.fullmatch(r"\d+", r[1]) and int(r[1]) <= int(r[0]) for r in rows)
        return "csv" if whole else "triangle"
    raise ValueError(f"{path} holds no rows")


def read_coeffs(spark: SparkSession, path: str, layout: str = "auto") -> DataFrame:
    """epoch_id, n, m, c, s of a text file in any of the layouts."""
    layout = detect_layout(spark, path) if layout == "auto" else layout
    if layout == "gfc":
        return read_gfc(spark, path).select(F.lit(0).alias("epoch_id"), "n", "m", "c", "s")
    return {"csv": read_coeff_csv, "triangle": read_triangle}[layout](spark, path)


def read_love(spark: SparkSession, path: str) -> DataFrame:
    """n, h, l, k of a table of load Love numbers; without names its columns are in this order."""
    rows, names = _rows(spark, path)
    at = {c: resolve(names, None, (c, f"{c}'", f"{c}n", f"{c}_n")) for c in ("n", "h", "l", "k")}
    at = {c: k if v is None else v for k, (c, v) in enumerate(at.items())}
    return rows.select(_value(at["n"]).cast("int").alias("n"), *[_value(at[c]).alias(c) for c in ("h", "l", "k")]).where("n is not null")


def looks_tidy(points: DataFrame) -> bool:
    """Whether the rows repeat their coordinates, as a table with a row for each time does, rather than being points."""
    row = points.agg(F.count("*").alias("n"), F.countDistinct("lat", "lon").alias("k")).first()
    return row["n"] > 0 and row["k"] < 0.6 * row["n"]


def read_series(
    spark: SparkSession, paths: str | list[str], nmax: int | None = None, strict_nmax: bool = False, epoch_from: str = "auto", on_duplicate: str = "error",
    order: str = "time", on_missing: str = "ignore", **select,
) -> tuple[DataFrame, DataFrame]:
    """(coeffs, epochs) of monthly model files, all read in one scan. Epochs come from headers or names (auto: headers
    first); files go by the parts of their names before they are opened, and of files listed one by one each must fit.
    order: time, name or none (as listed). Degrees that a file lacks are zeros, or with strict_nmax an error. on_missing,
    for months without a file: ignore, warn or error. What is odd is said in warnings: dates of name and header that differ
    by over a day, and gaps."""
    from orbweave.operators import timeaxis
    from orbweave.operators.coeffs import truncate

    listed = spark.read.format("binaryFile").load(paths).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    for key, col in name_fields(F.col("file")).items():
        listed = listed.withColumn(key, col)
    chosen = timeaxis.select_files(listed, strict=isinstance(paths, list), **select).toPandas()  # one row a file
    if not len(chosen):
        raise ValueError("no file fits")
    files = list(chosen["path"])
    mid, year = midpoint(F.col("start"), F.col("last"))
    named = spark.createDataFrame([(f,) for f in chosen["file"]], "file string")
    by_name = name_fields(F.col("file"))
    both = named.join(read_headers(spark, files), "file", "left").select("file", mid.alias("_hm"), year.alias("_hy"), by_name["mid"].alias("_nm"), by_name["decimal_year"].alias("_ny"))
    sources = {"auto": ("h", "n"), "header": ("h",), "filename": ("n",)}[epoch_from]
    dated = both.select("file", "_hm", "_nm", F.coalesce(*[F.col(f"_{o}m") for o in sources]).alias("ts"), F.coalesce(*[F.col(f"_{o}y") for o in sources]).alias("decimal_year"))
    epochs = dated.toPandas()
    if epochs["ts"].isna().any():
        raise ValueError("a file has no epoch")
    odd = timeaxis.conflicts(dated.select("file", F.col("_nm").alias("by_name"), F.col("_hm").alias("by_header"))).orderBy("file").limit(3).collect()
    if odd:
        warnings.warn(f"names and headers differ by over a day: {', '.join(r['file'] for r in odd)}", stacklevel=2)
    if order == "none":
        epochs = epochs.set_index("file").loc[chosen["file"]].reset_index()
    else:
        epochs = epochs.sort_values({"time": ["ts", "file"], "name": ["file"]}[order], kind="stable").reset_index(drop=True)
    table = spark.createDataFrame([(k, r.file, r.ts.to_pydatetime(), float(r.decimal_year)) for k, r in enumerate(epochs.itertuples())], "epoch_id int, label string, ts timestamp_ntz, decimal_year double")
    table = timeaxis.resolve_duplicates(table, on_duplicate)
    if on_missing != "ignore":
        gaps = timeaxis.missing(table).orderBy("ts").collect()
        said = "; ".join(f"{r['gap_days']:.0f} days before {r['label']}" for r in gaps)
        if gaps and on_missing == "error":
            raise ValueError(f"months are missing: {said}")
        if gaps:
            warnings.warn(f"months are missing: {said}", stacklevel=2)
    coeffs = read_gfc(spark, files, nmax).join(table.select("epoch_id", F.col("label").alias("file")), "file").select("epoch_id", "n", "m", "c", "s")
    tops = [r["t"] for r in coeffs.groupBy("epoch_id").agg(F.max("n").alias("t")).collect()]
    if strict_nmax and len(set(tops)) > 1:
        raise ValueError(f"files reach degrees {sorted(set(tops))}")
    return truncate(coeffs, max(tops)), table
