"""Epoch tables: epochs (epoch_id int, ts timestamp_ntz, ...). Epochs are few next to points."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions.calendar import DAYS, date_of, decimal_year, name_fields, numeric_time, seconds
from orbweave.operators.places import in_order

MONTH_DAYS = 31.0


def _beside(epochs: DataFrame, least: float | None = None) -> DataFrame:
    """epochs with gap_days to the epoch before, _next to the one after and, for runs of gaps below ``least``, run. Stretches of
    the axis are looked at side by side; what each needs of the others, its neighbours' ends and the runs before it, is
    a row a stretch, which the driver adds up."""
    x = seconds(F.col("ts"))
    rows, inside = in_order(epochs, "ts", "epoch_id"), Window.partitionBy("_range").orderBy("_at")
    first, last = F.col("_at") == 0, F.lead("_at").over(inside).isNull()
    rows = rows.withColumn("_gap", (x - F.lag(x).over(inside)) / DAYS).withColumn("_next", (F.lead(x).over(inside) - x) / DAYS).withColumn("_last", last)
    fresh = F.coalesce((F.col("_gap") >= least).cast("long"), F.lit(1).cast("long")) if least is not None else F.lit(0).cast("long")
    ends = rows.groupBy("_range").agg(F.min_by(x, "_at").alias("lo"), F.max_by(x, "_at").alias("hi"), F.sum(F.when(~first, fresh)).alias("runs")).orderBy("_range").collect()
    table, runs = [], 0
    for k, e in enumerate(ends):
        before = ends[k - 1]["hi"] if k else None
        after = ends[k + 1]["lo"] if k + 1 < len(ends) else None
        gap = (e["lo"] - before) / DAYS if before is not None and e["lo"] is not None else None
        runs += int(least is not None and (gap is None or gap >= least))
        table.append((e["_range"], gap, (after - e["hi"]) / DAYS if after is not None and e["hi"] is not None else None, runs))
        runs += e["runs"] or 0
    edges = F.broadcast(epochs.sparkSession.createDataFrame(table, "_range int, _before double, _after double, _runs long"))  # a row a stretch
    out = rows.join(edges, "_range")
    if least is not None:
        out = out.withColumn("run", F.col("_runs") + F.coalesce(F.sum(F.when(~first, fresh)).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    out = out.withColumn("gap_days", F.when(first, F.col("_before")).otherwise(F.col("_gap"))).withColumn("_next", F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_next")))
    return out.drop("_range", "_at", "_gap", "_last", "_before", "_after", "_runs")


def with_gaps(epochs: DataFrame) -> DataFrame:
    """epochs with gap_days to the epoch before."""
    return _beside(epochs).drop("_next")


def missing(epochs: DataFrame, most: float = MONTH_DAYS + 6) -> DataFrame:
    """Epochs that come more than ``most`` days after the one before."""
    return with_gaps(epochs).where(F.col("gap_days") > most)


def duplicates(epochs: DataFrame, least: float = 1.0) -> DataFrame:
    """epochs in runs of gaps below ``least`` days, with run, the number of the run."""
    return _beside(epochs, least).where((F.col("gap_days") < least) | (F.col("_next") < least)).drop("_next")


def regular(epochs: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """One row: median_days and regular, whether all gaps are within the tolerance of it."""
    gaps = with_gaps(epochs).where("gap_days is not null").select("gap_days")
    mid = gaps.agg(F.median("gap_days").alias("median_days"))
    return gaps.join(F.broadcast(mid)).groupBy("median_days").agg((F.max(F.abs(F.col("gap_days") - F.col("median_days"))) <= tolerance).alias("regular"))


def with_decimal_year(epochs: DataFrame) -> DataFrame:
    """decimal_year, from a hint column of that name where it is filled."""
    year = decimal_year(F.col("ts"))
    return epochs.withColumn("decimal_year", F.coalesce("decimal_year", year) if "decimal_year" in epochs.columns else year)


def between(epochs: DataFrame, first: Column, last: Column) -> DataFrame:
    """Epochs of the window, both ends included; an empty one is an error."""
    out = epochs.where(F.col("ts").between(first, last))
    if not out.take(1):
        raise ValueError("no epoch in the window")
    return out


def nearest(epochs: DataFrame, ts: Column) -> DataFrame:
    """The epoch next to ts, of equally near ones the earlier."""
    off = F.abs(seconds(F.col("ts")) - seconds(ts))
    row = epochs.agg(F.min_by(F.struct(*epochs.columns), F.struct(off.alias("off"), F.col("ts"), F.col("epoch_id"))).alias("e"))
    return row.select("e.*")


def match(left: DataFrame, right: DataFrame, tolerance_days: float) -> DataFrame:
    """epoch_id, other_id, gap_days: for each epoch the nearest of the other set within the tolerance. Epochs meet in
    boxes of the tolerance, so no pair further apart is formed."""
    box = F.lit(max(tolerance_days, 1e-6) * DAYS)
    a = left.select("epoch_id", seconds(F.col("ts")).alias("x")).withColumn("b", F.explode(F.array(*[F.floor(F.col("x") / box) + k for k in (-1, 0, 1)])))
    b = right.select(F.col("epoch_id").alias("other_id"), seconds(F.col("ts")).alias("y")).withColumn("b", F.floor(F.col("y") / box))
    near = a.join(b, "b").withColumn("gap_days", F.abs(F.col("x") - F.col("y")) / DAYS).where(F.col("gap_days") <= tolerance_days)
    best = Window.partitionBy("epoch_id").orderBy("gap_days", "other_id")
    return near.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("epoch_id", "other_id", "gap_days")


def from_names(files: DataFrame, name: str = "name") -> DataFrame:
    """files with the parts of monthly model names; rows of another form are kept with nulls."""
    out = files
    for key, col in name_fields(F.col(name)).items():
        out = out.withColumn(key, col)
    return out


def from_index(spark: SparkSession, n: int) -> DataFrame:
    """n epochs without dates: ts is null and kind is index; what needs dates finds none."""
    return spark.range(n).select(F.col("id").cast("int").alias("epoch_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("index").alias("kind"))


def axis_from(spark: SparkSession, values, units: str | None = None) -> DataFrame | None:
    """epochs (epoch_id, ts, kind, note) of whatever says when they are: an epoch table, a dictionary with values and
    units, dates or texts of dates, numbers with units (seconds to days since a date), or numbers alone, which give an
    axis without dates. Units without a fixed length give such an axis as well, with a note; texts that are no dates, and
    nothing, give none."""
    if isinstance(values, DataFrame):
        return values
    if isinstance(values, dict):
        values, units = values.get("values"), values.get("units", units)
    if values is None:
        return None
    values = list(values)
    kinds = {type(v) for v in values}
    schema = "epoch_id int, ts timestamp_ntz, kind string, note string"
    if values and all(isinstance(v, (dt.date, dt.datetime)) for v in values):
        rows = [(k, v if isinstance(v, dt.datetime) else dt.datetime.combine(v, dt.time()), "datetime", None) for k, v in enumerate(values)]
        return spark.createDataFrame(rows, schema)
    if kinds == {str}:
        try:
            return spark.createDataFrame([(k, dt.datetime.fromisoformat(_whole_date(v)), "datetime", None) for k, v in enumerate(values)], schema)
        except ValueError:
            return None
    note = "only their order is known"
    if units is not None:
        try:
            rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "epoch_id int, v double")
            return rows.select("epoch_id", numeric_time(F.col("v"), units).alias("ts"), F.lit("datetime").alias("kind"), F.lit(None).cast("string").alias("note"))
        except ValueError as e:
            note = str(e)
    return from_index(spark, len(values)).withColumn("note", F.lit(note))


def _whole_date(text: str) -> str:
    text = text.strip().removesuffix("Z")
    parts = text.split("-")
    return "-".join([parts[0], *[p.zfill(2) for p in parts[1:]], *["01"] * (3 - len(parts))]) if len(parts) < 3 else text


def to_dict(epochs: DataFrame) -> dict:
    """An epoch table as plain values: kind, seconds since 1970 (none without a date), hints of decimal years, labels."""
    rows = epochs.orderBy("epoch_id").collect()
    has = lambda c: c in epochs.columns
    zero = dt.datetime(1970, 1, 1)
    return {
        "kind": rows[0]["kind"] if rows and has("kind") else "datetime", "epoch_id": [r["epoch_id"] for r in rows],
        "values_s": [None if r["ts"] is None else int((r["ts"] - zero).total_seconds()) for r in rows],
        "decimal_year_hint": [r["decimal_year"] for r in rows] if has("decimal_year") else None, "labels": [r["label"] for r in rows] if has("label") else None,
    }


def from_dict(spark: SparkSession, d: dict) -> DataFrame:
    """The table of ``to_dict``."""
    n = len(d["values_s"])
    ids, hints, labels = d.get("epoch_id") or range(n), d.get("decimal_year_hint") or [None] * n, d.get("labels") or [None] * n
    zero = dt.datetime(1970, 1, 1)
    rows = [(int(e), None if v is None else zero + dt.timedelta(seconds=v), d.get("kind", "datetime"), label, hint) for e, v, label, hint in zip(ids, d["values_s"], labels, hints)]
    return spark.createDataFrame(rows, "epoch_id int, ts timestamp_ntz, kind string, label string, decimal_year double")


def with_times(coeffs: DataFrame, epochs: DataFrame) -> DataFrame:
    """coeffs with ts of their epochs; it is an error if the table lacks one of them or names one twice."""
    have = coeffs.select("epoch_id").distinct()
    if have.join(epochs, "epoch_id", "left_anti").take(1):
        raise ValueError("an epoch of the series has no row in the epoch table")
    if epochs.groupBy("epoch_id").count().where("count > 1").take(1):
        raise ValueError("the epoch table names an epoch twice")
    return coeffs.join(epochs.select("epoch_id", "ts"), "epoch_id")


def conflicts(files: DataFrame, most_days: float = 1.0) -> DataFrame:
    """Of files with two dates, by_name and by_header, those that differ by more than a day: file, by_name, by_header,
    days."""
    days = F.abs(seconds(F.col("by_name")) - seconds(F.col("by_header"))) / DAYS
    return files.withColumn("days", days).where(F.col("days") > most_days).select("file", "by_name", "by_header", "days")


def from_labels(labels: DataFrame) -> DataFrame:
    """epochs of (epoch_id, label) with labels YYYY, YYYY-MM, YYYY-MM-DD or a time of day; others are an error."""
    text = F.trim("label")
    full = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike(r"^\d{4}-\d{1,2}$"), F.concat(text, F.lit("-01"))).otherwise(text)
    ts = F.coalesce(full.try_cast("timestamp_ntz"), F.raise_error(F.concat(F.lit("no date in "), text)).cast("timestamp_ntz"))
    return labels.select("epoch_id", ts.alias("ts"), "label", F.lit("datetime").alias("kind"))


def from_decimal_years(years: DataFrame) -> DataFrame:
    """epochs (epoch_id, ts, decimal_year) of epoch_id and decimal_year, which stays as the hint."""
    return years.select("epoch_id", date_of(F.col("decimal_year")).alias("ts"), "decimal_year")


def legacy_table(epochs: DataFrame) -> DataFrame:
    """idx (from 1), y_start, y_end, y_mid in decimal years of six digits, for epochs with start, end and ts."""
    rows = epochs.select("epoch_id", *[F.round(decimal_year(F.col(c)), 6).alias(n) for c, n in (("start", "y_start"), ("end", "y_end"), ("ts", "y_mid"))])
    return rows.select((F.col("epoch_id") + 1).alias("idx"), "y_start", "y_end", "y_mid")


def select_files(files: DataFrame, product: str | None = None, mission: str | None = None, center: str | None = None, rl: str | None = None, strict: bool = False) -> DataFrame:
    """Files by the parts of their names. strict, for files that were listed one by one: one that doesn't fit is an error."""
    keep = F.lit(True)
    for col, value in (("product", product), ("mission", mission), ("center", center), ("rl", rl)):
        if value is not None:
            keep &= F.coalesce(F.upper(col) == value.upper(), F.lit(False))
    if strict and files.where(~keep).take(1):
        raise ValueError("a listed file doesn't fit the filters")
    return files.where(keep)


def resolve_duplicates(epochs: DataFrame, how: str = "error", least: float = 1.0) -> DataFrame:
    """Of epochs less than a day apart: error raises, first and last keep that one of each run."""
    again = duplicates(epochs, least)
    if how == "error":
        if again.take(1):
            raise ValueError("epochs coincide")
        return epochs
    side = F.row_number().over(Window.partitionBy("run").orderBy(*([F.col("ts"), F.col("epoch_id")] if how == "first" else [F.desc("ts"), F.desc("epoch_id")])))
    return epochs.join(again.withColumn("_r", side).where("_r > 1").select("epoch_id"), "epoch_id", "left_anti")
