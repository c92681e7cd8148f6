"""Samples, rows kept whole, and the intermediate tables of the core."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.sources.storage import discard, new_dir, shared_dir, stored

__all__ = ["bounded_texts", "discard", "hashed_sample", "new_dir", "partitions", "shared_dir", "stored", "whole"]

#: Bytes of whole texts that a sample brings to the driver at most.
SAMPLE_BYTES = 32 << 20


def hashed_sample(rows: DataFrame, most: int, *keys: str, seed: str = "sample") -> DataFrame:
    """At most ``most`` rows, those with the least hashes of the keys; all rows where there are no more. Only rows below
    a bound on the hash that lets about twice as many pass are sorted."""
    n = rows.count()
    h = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40))
    bound = (1 << 40) if n <= 2 * most else int((1 << 40) * (2 * most / n)) + 1
    return rows.withColumn("_h", h).where(F.col("_h") < bound).orderBy("_h", *keys).limit(most).drop("_h")


def bounded_texts(rows: DataFrame, most: int = SAMPLE_BYTES) -> pa.Table:
    """rows, bounded in number and with a column text, in an order by hash: whole texts up to ``most`` bytes together. A
    text of more than a sixteenth of that, or that doesn't fit any more, is passed over, never cut."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64
    kept = stored(rows.withColumn("_size", size).withColumn("_key", F.xxhash64(*rows.columns, F.lit("bounded"))), "sample")
    sizes = kept.groupBy("_key").agg(F.sum("_size").alias("size"), F.max("_size").alias("one")).orderBy("_key").collect()
    left, take = most, []
    for key, all_, one in sizes:
        if one <= most // 16 and all_ <= left:
            take.append((int(key),))
            left -= all_
    chosen = F.broadcast(rows.sparkSession.createDataFrame(take, "_key long"))  # as many as the rows at most
    out = kept.join(chosen, "_key").orderBy("_key").select(*rows.columns).toArrow()
    discard(kept)
    return out


def whole(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows as one struct ``r``, beside keys of our own, so that no column's name can clash with these."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), *[v.alias(k) for k, v in keys.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
