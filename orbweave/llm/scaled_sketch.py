"""Document fingerprints as threshold-scaled sketches.

A fingerprint keeps every shingle hash below a fixed fraction of the hash range, so the size follows the document, the
sketch of a union is the union of the sketches, and containment can be told between documents of very unequal length.
Shingles are five words (A-Z as a-z) of the text set between four marks on either side; a text with n words has n + 4.
Where no hash is below the threshold, the smallest stays, so that every text with a word has a fingerprint.

A null text is empty; an empty text has the empty fingerprint, which is like itself (1) and unlike all others (0).
An empty table gives an empty one.
Equal texts have equal fingerprints. Among rows with one doc_id the order is by a hash of the text and then the text; rows
without a doc_id come first. Where very many share a doc_id or have none, ranges of that hash part them. A text of any
length is taken whole; only doc_id and text are read, so other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.storage import partitions
from orbweave.llm.textcols import Words, distinct, shingles, slices, words

SIZE = 5
#: One hash in so many is kept.
SCALE = 4


def padded_shingles(w: Words, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    n = len(w.first) - 1
    pad = size - 1
    counts = w.counts
    first = np.where(counts > 0, counts + 2 * pad, 0)
    first = np.concatenate([[0], np.cumsum(first)])
    full = np.full(first[-1], 0x5DEECE66D, np.uint64)
    doc = np.repeat(np.arange(n), counts)
    full[np.arange(len(doc)) - w.first[doc] + first[doc] + pad] = w.hashes()
    return shingles(full, first, size)


def sketches(texts: pa.Array, scale: int = SCALE) -> list[np.ndarray]:
    """Each text's kept hashes, ascending."""
    values, bounds = padded_shingles(words(texts, lower=True))
    limit = np.uint64((1 << 64) // scale - 1)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keep = values <= limit
    some = np.bincount(doc[keep], minlength=len(bounds) - 1) > 0
    if len(values):
        least = np.full(len(bounds) - 1, np.iinfo(np.uint64).max, np.uint64)
        filled = np.diff(bounds) > 0
        least[filled] = np.minimum.reduceat(values, bounds[:-1][filled])
        keep |= ~some[doc] & (values == least[doc])
    kept, cuts = distinct(values[keep], np.searchsorted(doc[keep], np.arange(len(bounds))))
    return np.split(kept, cuts[1:-1])


def as_text(sketch: np.ndarray) -> str:
    """Hexadecimal, 16 digits a hash, ascending."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of both documents together."""
    both = np.union1d(a, b)
    low = both[both <= np.uint64((1 << 64) // scale - 1)]
    return low if len(low) else both[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the smaller sketch that the other contains."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id and fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [as_text(s) for s in sketches(part.column("text"), scale)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, bucket, tail: the rows in n = 4 * parts ranges of doc_id, each range sorted in a partition, and
    after it, as tail, the first row of the next range (after the last: of the first). Only range bounds and the first
    doc_id of each range, n numbers, go through the driver."""
    n = 4 * parts  # several small ranges to a partition even its size out
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 20)))
    per_id = docs.groupBy("doc_id").count().agg(F.max("count").alias("most"), F.sum("count").alias("all"), F.min("doc_id").alias("least")).first()
    hot = (per_id["most"] or 0) * n > max(4000, per_id["all"] or 0)  # more rows of one doc_id than a range should have
    least = float(per_id["least"] if per_id["least"] is not None else 0)
    x = F.coalesce(F.col("doc_id").cast("double"), F.lit(least - 2.0))
    x = x + F.col("h") / F.lit(float(1 << 20)) if hot else x
    inner = docs.select(F.percentile_approx(x, [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else []
    splits = [float("-inf"), *sorted({float(b) for b in inner or ()}), float("inf")]
    if len(splits) > 2:
        keyed = Bucketizer(splits=splits, inputCol="x", outputCol="y").transform(docs.withColumn("x", x))
        keyed = keyed.select("doc_id", "text", "h", F.col("y").cast("int").alias("bucket"))
    else:
        keyed = docs.withColumn("bucket", F.lit(0))
    id_, part = F.coalesce("doc_id", F.lit(-(1 << 63))), F.col("h") if hot else F.lit(0).cast("long")
    heads = keyed.groupBy("bucket").agg(F.min(F.struct(id_.alias("id"), part.alias("part"))).alias("head")).orderBy("bucket").collect()
    goes = [(row["head"]["id"], row["head"]["part"], heads[k - 1]["bucket"]) for k, row in enumerate(heads)]
    small = docs.sparkSession.createDataFrame(goes, "head long, part long, before int")
    tails = docs.join(F.broadcast(small), (id_ == F.col("head")) & (part == F.col("part"))).select("doc_id", "text", "h", F.col("before").alias("bucket"), F.lit(True).alias("tail"))
    rows = keyed.withColumn("tail", F.lit(False)).unionByName(tails).repartition(parts, "bucket")
    return rows.sortWithinPartitions("bucket", "tail", "doc_id", "h", "text").drop("h")


def with_edits(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """The contract's columns: each text is fingerprinted, and so is its edit, whose last half is the next document's
    beginning."""
    rows = in_order(docs, partitions(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, str] | None = None
        at = None  # the held row's bucket
        for batch in batches:
            for part in slices(batch):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                mine, after = [], []
                for i, t, b, tail in zip(ids, texts, part.column("bucket").to_pylist(), part.column("tail").to_pylist()):
                    if held is not None and b == at:
                        mine.append(held)
                        after.append(t)
                    held, at = (None if tail else (i, t)), b
                if mine:
                    yield edited(mine, after)

    def edited(mine: list[tuple[int | None, str]], after: list[str]) -> pa.RecordBatch:
        own = [t for _, t in mine]
        edits = [t[: len(t) - len(t) // 2] + a[: len(t) // 2] for t, a in zip(own, after)]
        chain = sketches(pa.array([*own, after[-1]], pa.large_string()), scale)
        chained = [own[k + 1] is after[k] for k in range(len(own) - 1)] + [True]
        nexts = [chain[k + 1] if c else sketches(pa.array([after[k]], pa.large_string()), scale)[0] for k, c in enumerate(chained)]
        of_edits = sketches(pa.array(edits, pa.large_string()), scale)
        cols = [
            pa.array([i for i, _ in mine], pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]),
            pa.array([as_text(s) for s in chain[:-1]]), pa.array([as_text(s) for s in of_edits]),
            pa.array([likeness(a, b) for a, b in zip(chain, of_edits)]), pa.array([likeness(a, b) for a, b in zip(chain, nexts)]),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
