"""Points and series derived from the star-schema tables, which hold no coordinates of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.geo import fibonacci


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on a Fibonacci sphere: point_id, lat, lon, value (balance), nation."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_acctbal").alias("value"), F.col("c_nationkey").alias("nation"))
    return fibonacci(c, "point_id", c.count())


def cells(spark: SparkSession, sf_dir: str, *by: F.Column) -> DataFrame:
    """Order lines on an 18 x 36 grid: ilat, ilon, lat -85..85, lon 0..350, value (mean quantity), and by."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 18).cast("int").alias("ilat"), (F.col("l_orderkey") % 36).cast("int").alias("ilon"), "l_quantity", *by)
    names = [c for c in rows.columns if c not in ("ilat", "ilon", "l_quantity")]
    out = rows.groupBy("ilat", "ilon", *names).agg(F.avg("l_quantity").alias("value"))
    return out.select((F.col("ilat") * 36 + F.col("ilon")).cast("long").alias("point_id"), "ilat", "ilon", (F.col("ilat") * 10.0 - 85.0).alias("lat"), (F.col("ilon") * 10.0).alias("lon"), *names, "value")


def yearly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir, F.year("l_shipdate").alias("epoch_id"))


def monthly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells by month (months since year 0). On small tables months lack cells, each others."""
    return cells(spark, sf_dir, (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("epoch_id"))


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficient-like monthly series of order lines: epoch_id (months since year 0), ts (first of the month), n, m, c, s:
    mean quantity and discount by n = part key mod 3 and m = order key mod (n + 1); s is 0 where m is."""
    rows = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_quantity", "l_discount", (F.col("l_partkey") % 3).cast("int").alias("n"), "l_orderkey")
    rows = rows.withColumn("m", (F.col("l_orderkey") % (F.col("n") + 1)).cast("int"))
    day = F.to_date("l_shipdate")
    rows = rows.withColumn("epoch_id", F.year(day) * 12 + F.month(day) - 1).withColumn("ts", F.make_date(F.year(day), F.month(day), F.lit(1)).cast("timestamp_ntz"))
    return rows.groupBy("epoch_id", "ts", "n", "m").agg(F.avg("l_quantity").alias("c"), F.avg(F.when(F.col("m") > 0, F.col("l_discount")).otherwise(0.0)).alias("s"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event days: epoch_id (days since 1970), ts, value (mean)."""
    day = F.to_date("ts")
    rows = table(spark, sf_dir, "events").select(day.alias("d"), "value").groupBy("d").agg(F.avg("value").alias("value"))
    return rows.select(F.datediff("d", F.lit("1970-01-01").cast("date")).alias("epoch_id"), F.col("d").cast("timestamp_ntz").alias("ts"), "value")
