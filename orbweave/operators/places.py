"""Places on the sphere and on its axes: distinct coordinates, neighbours in order, and boxes in which near places meet."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.sources.storage import discard, stored

#: Ranges of an axis that are put in order side by side.
RANGES = 256
#: Places in a box at which the search for the nearest starts, at most.
CROWD = 256


def sites(points: DataFrame) -> DataFrame:
    """The points of a series (epoch_id), each once, with point_id where there is one, lat and lon. Points without epochs
    are as they are."""
    if "epoch_id" not in points.columns:
        return points
    return points.select(*[c for c in ("point_id", "lat", "lon") if c in points.columns]).distinct()


def beside(axis: DataFrame, v: str) -> DataFrame:
    """axis (one row for each distinct v) with _p and _n, the values before and after, and _a and _b, the least and the
    largest of all. Ranges of values between quantiles are ordered side by side, and only their ends, a row a range, meet
    in one task."""
    axis = axis.where(F.col(v).isNotNull())
    cuts = axis.agg(F.percentile_approx(v, [k / RANGES for k in range(1, RANGES)], 4096).alias("_cuts"))
    ranged = axis.join(F.broadcast(cuts)).withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col(v)))).drop("_cuts")
    inside = Window.partitionBy("_r").orderBy(v)
    rows = ranged.withColumn("_p", F.lag(v).over(inside)).withColumn("_n", F.lead(v).over(inside))
    by_range, all_ = Window.orderBy("_r"), Window.partitionBy()
    ends = ranged.groupBy("_r").agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))  # RANGES rows at most
    ends = ends.select("_r", F.lag("_hi").over(by_range).alias("_below"), F.lead("_lo").over(by_range).alias("_above"), F.min("_lo").over(all_).alias("_a"), F.max("_hi").over(all_).alias("_b"))
    rows = rows.join(F.broadcast(ends), "_r")
    return rows.withColumn("_p", F.coalesce("_p", "_below")).withColumn("_n", F.coalesce("_n", "_above")).drop("_r", "_below", "_above")


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows with _range, a stretch of the order by the keys, and _at, the place in it from 0. Stretches are sorted side by
    side and stored; equal values of the first keys are parted by the last."""
    bits = 33  # of monotonically_increasing_id, which number the rows of a partition
    at = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at)
    return stored(ordered.withColumn("_range", F.shiftright("_at", bits).cast("int")).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << bits) - 1))), "in-order")


def ordinals(axis: DataFrame, v: str) -> DataFrame:
    """v and at, its place (from 0) among the distinct values in ascending order; ranges are counted side by side."""
    axis = axis.where(F.col(v).isNotNull())
    cuts = axis.agg(F.percentile_approx(v, [k / RANGES for k in range(1, RANGES)], 4096).alias("_cuts"))
    ranged = axis.join(F.broadcast(cuts)).select(v, F.size(F.filter("_cuts", lambda c: c < F.col(v))).alias("_r"))
    before = ranged.groupBy("_r").count().select("_r", F.coalesce(F.sum("count").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_r").orderBy(v)) - 1
    return ranged.withColumn("at", inside).join(F.broadcast(before), "_r").select(v, (F.col("at") + F.col("_before")).cast("int").alias("at"))


def spot(points: DataFrame) -> DataFrame:
    """The points with lat and lon of their place as la and lo: one longitude for each place, 0 at the poles."""
    return points.withColumn("la", F.col("lat") + 0.0).withColumn("lo", F.when(F.abs("lat") >= 90.0, 0.0).otherwise(F.pmod(F.col("lon") + 0.0, F.lit(360.0))))


def spots(points: DataFrame) -> DataFrame:
    """la, lo, n: the distinct places and how many points are there; a point of several epochs is one."""
    whole = spot(sites(points)).where("la is not null and lo is not null and not isnan(la) and not isnan(lo)")
    return stored(whole.groupBy("la", "lo").agg(F.count("*").alias("n")), "spots")


def boxes(box: float):
    """Columns i and j of la and lo in boxes of ``box`` degrees; those of the box itself and of all that hold places within
    that distance. A band's boxes are as wide as the distance is at its edge next to the pole."""
    i = F.floor((F.col("la") + 90.0) / box).cast("long")
    edge = lambda i: F.greatest(F.abs(i * box - 90.0), F.abs((i + 1) * box - 90.0)) + box
    across = lambda i: F.when(edge(i) >= 90.0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(edge(i))) / box))).cast("long")
    place = lambda k: F.least(k - 1, F.floor(F.col("lo") / 360.0 * k).cast("long"))

    def own(df: DataFrame) -> DataFrame:
        return df.withColumn("i", i).withColumn("j", place(across(F.col("i"))))

    def near(df: DataFrame) -> DataFrame:
        df = df.withColumn("i", F.explode(F.array(i - 1, i, i + 1))).withColumn("_k", across(F.col("i")))
        j = place(F.col("_k"))
        return df.withColumn("j", F.explode(F.array_distinct(F.transform(F.array(j - 1, j, j + 1), lambda x: F.pmod(x, F.col("_k")))))).drop("_k")

    return own, near


def box_for(spots: DataFrame, many: int, crowd: int) -> float:
    """A size of boxes with about ``many`` places in one on average, less where the fullest box holds over ``crowd``."""
    m = spots.count()
    box = min(180.0, float(np.sqrt(41253.0 * many / max(1, m))))
    while m and box > 1e-9 and boxes(box)[0](spots).groupBy("i", "j").count().agg(F.max("count")).first()[0] > crowd:
        box /= 2.0
    return box


def others(spots: DataFrame) -> DataFrame:
    return spots.select(F.col("la").alias("la2"), F.col("lo").alias("lo2"), *[c for c in spots.columns if c not in ("la", "lo")])


def same() -> Column:
    return (F.col("la") == F.col("la2")) & (F.col("lo") == F.col("lo2"))


def spacing(points: DataFrame) -> DataFrame:
    """point_id, degrees: distance to the nearest other point, however far; null without another one.

    Places meet in boxes, from a size at which no box holds more than CROWD of them. Those without another place within
    the box's size meet in boxes of twice the size; as they are so far apart, few of them meet any one place."""
    every = spots(points)
    m, box = every.count(), box_for(every, 1, CROWD)
    left = every.where("n = 1").select("la", "lo")
    found, open_ = [every.where("n > 1").select("la", "lo", F.lit(0.0).alias("degrees"))], left.count() if m > 1 else 0
    while open_:
        own, near = boxes(box)
        chunks = int(min(64, max(1, m // open_)))  # of a large box's places
        chunk = F.pmod(F.xxhash64("la", "lo"), F.lit(chunks))
        asking = near(left).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
        half = lambda x, y: F.pow(F.sin((F.radians(x) - F.radians(y)) / 2.0), 2.0)
        chord = half("la", "la2") + F.cos(F.radians("la")) * F.cos(F.radians("la2")) * half("lo", "lo2")
        best = asking.join(others(own(every.select("la", "lo")).withColumn("chunk", chunk)), ["i", "j", "chunk"]).where(~same()).groupBy("la", "lo").agg(F.min(chord).alias("chord"))
        best = best.select("la", "lo", F.degrees(2.0 * F.asin(F.sqrt(F.least(F.lit(1.0), "chord")))).alias("degrees"))
        if box < 180.0:
            best = best.where(F.col("degrees") <= box * (1.0 - 1e-9))
        best = stored(best, "nearest")
        found.append(best)
        if box >= 180.0:
            break
        before = left
        left = stored(left.join(best, ["la", "lo"], "left_anti"), "isolated")
        if hasattr(before, "stored_at"):
            discard(before)
        open_, box = left.count(), min(180.0, box * 2.0)
    return spot(sites(points)).join(reduce(DataFrame.unionByName, found), ["la", "lo"], "left").select("point_id", "degrees")
