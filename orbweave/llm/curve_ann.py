"""Approximate nearest neighbours by shifted Hilbert curves.

The nearest are those of the largest inner product. Vectors get one more coordinate that lifts them to one length, that
of the 99th percentile, longer ones being shortened to it; queries are stretched to that length and get 0 there. Then
near in space is large in product. All are projected to a few dimensions, shifted and put in the order of a Hilbert curve,
several times with other projections and shifts. Each order is range-partitioned in Spark and cut into windows of as many
rows; a query is compared with all rows of its own window and of the two beside it, in double precision on the original
vectors, and what the curves find is merged and ranked again.

The window is the smallest, of powers of two from 512 rows on, with which the curves find ``recall`` of the true
neighbours of a bounded sample of queries; these are found by comparing the sample with every row. On vectors that
have structure windows stay small. On isotropic vectors of many dimensions no order keeps neighbours together, and
windows grow with the table.

Equal vectors are one point of the curves; its first ``k`` + 1 rows stand for all. Vectors that are null, zero, of another
length than most, or hold null or non-finite components take no part, nor do rows without a vec_id. Rows are numbered
in the order of vec_id; those that share one are rows like others, each asks for itself and is found by the others. Ties
go to the smaller vec_id. An empty table gives an empty one. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.storage import discard, hashed_sample, partitions, stored

CURVES = 12
DIMS = 8
BITS = 7
K = 20
RECALL = 0.96
SAMPLE = 200
LEAST = 512
#: Rows of a window that one group compares, about; a larger window is dealt to several groups.
POOL = 16_384


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each cell (rows x dimensions, integers below 2**bits) on the Hilbert curve, as a non-negative long."""
    x = np.ascontiguousarray(cells.T).astype(np.uint32)
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = np.uint32(1 << b), np.uint32((1 << b) - 1)
        for i in range(n):
            turned = (x[i] & q) > 0
            swap = np.where(turned, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    last = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        last ^= np.where((x[n - 1] & np.uint32(1 << b)) > 0, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= last
    key = np.zeros(len(x[0]), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> np.uint32(b) & np.uint32(1))
    return key


def projections(width: int, curves: int, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each curve orthonormal directions and a shift in cells of a unit cube."""
    rng = np.random.default_rng(seed)
    dims = min(DIMS, width)
    return [(np.linalg.qr(rng.normal(size=(width, dims)))[0], rng.uniform(-0.2, 0.2, dims)) for _ in range(curves)]


def valid(rows: DataFrame, vector: str) -> DataFrame:
    """row, vec_id and v (array<double>) of the rows that take part; ``row`` ascends with vec_id. Ranges of vec_id are sorted
    side by side; a hot vec_id is parted by the rows' places in the table."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    rows = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange("vec_id", "at").sortWithinPartitions("vec_id", "at")
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "ann-rows")
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == F.lit(most["n"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Per row the places of the k largest scores, ties to the smaller id; not in order."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    edge = np.partition(scores, n - k, axis=1)[:, n - k]
    out = np.empty((len(scores), k), np.int64)
    for r in range(len(scores)):
        at = np.flatnonzero(scores[r] >= edge[r] - 1e-12 * max(1.0, abs(edge[r])))
        out[r] = at[np.lexsort((ids[at], -scores[r, at]))[:k]]
    return out


def _nearest(q: np.ndarray, pool: np.ndarray, ids: np.ndarray, k: int, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of each query's k best of the pool. Scores are summed pair by pair, the same in every grouping."""
    found_ids, found = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
    for a in range(0, len(pool), block):
        part, names = pool[a : a + block], ids[a : a + block]
        at = _best(q @ part.T, names, k)
        exact = np.stack([(part[at[r]] * q[r]).sum(1) for r in range(len(q))]) if len(q) else np.zeros(at.shape)
        found_ids, found = np.concatenate([found_ids, names[at]], 1), np.concatenate([found, exact], 1)
        if found.shape[1] > k:
            order = np.stack([np.lexsort((found_ids[r], -found[r]))[:k] for r in range(len(q))])
            found_ids, found = np.take_along_axis(found_ids, order, 1), np.take_along_axis(found, order, 1)
    return found_ids, found


def _pairs(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(np.repeat(queries, ids.shape[1])), pa.array(ids.ravel()), pa.array(scores.ravel())]
    return pa.RecordBatch.from_arrays(cols, names=["q", "point", "score"])


def exact(points: DataFrame, queries: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """(q, point, score): the k best of all points for a bounded set of queries."""
    shared = points.sparkSession.sparkContext.broadcast((queries, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, vectors = shared.value
        for batch in batches:
            if batch.num_rows:
                yield _pairs(queries, *_nearest(vectors, _matrix(batch.column("v")), batch.column("point").to_numpy(), k))

    found = points.select("point", "v").mapInArrow(run, "q long, point long, score double")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "point"))).where(F.col("n") <= k).drop("n")


def lifted(v: np.ndarray, length: float) -> np.ndarray:
    """The vectors with a coordinate that brings them to ``length``; longer ones are shortened to it."""
    size = np.linalg.norm(v, axis=1)
    short = v * np.minimum(1.0, length / size)[:, None]
    return np.concatenate([short, np.sqrt(np.maximum(0.0, length**2 - size**2))[:, None]], 1)


def stretched(v: np.ndarray, length: float) -> np.ndarray:
    """Queries at ``length``, with 0 for the coordinate more."""
    return np.concatenate([v * (length / np.linalg.norm(v, axis=1))[:, None], np.zeros((len(v), 1))], 1)


def ordered(points: DataFrame, width: int, curves: int) -> DataFrame:
    """(curve, point, asks, place): the place of every point in every order, and again, with asks, of those that ask, as
    queries."""
    spark = points.sparkSession
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    length = float(points.agg(F.percentile_approx(size, 0.99)).first()[0] or 1.0)
    spread = 6 * length / float(np.sqrt(width + 1))  # six times a component's deviation in a random direction
    shared = spark.sparkContext.broadcast(projections(width + 1, curves))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids, asks = _matrix(batch.column("v")), batch.column("point").to_numpy(), np.array(batch.column("asks").to_pylist(), bool)
            every = np.concatenate([lifted(v, length), stretched(v[asks], length)])
            who, role = np.concatenate([ids, ids[asks]]), np.repeat([False, True], [len(ids), int(asks.sum())])
            for c, (p, shift) in enumerate(shared.value):
                cells = np.clip((every @ p / spread + 0.5 + shift) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), c, np.int32)), pa.array(hilbert(cells, BITS)), pa.array(who), pa.array(role)], names=["curve", "key", "point", "asks"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = np.zeros(curves, np.int64)
        me = TaskContext.get().partitionId()
        for batch in batches:
            c = batch.column("curve").to_numpy()
            place = np.empty(len(c), np.int64)
            for k in np.unique(c):
                at = np.flatnonzero(c == k)
                place[at] = done[k] + np.arange(len(at))
                done[k] += len(at)
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("curve", "point", "asks")], pa.array(place), pa.array(np.full(len(c), me, np.int32))], names=["curve", "point", "asks", "place", "part"])

    line = points.select("point", "v", "asks").mapInArrow(keys, "curve int, key long, point long, asks boolean")
    line = line.repartitionByRange(partitions(spark), "curve", "key", "point", "asks").sortWithinPartitions("curve", "key", "point", "asks")
    line = stored(line.mapInArrow(number, "curve int, point long, asks boolean, place long, part int"), "ann-order")
    counts = line.groupBy("curve", "part").count().orderBy("curve", "part").collect()  # a partition and curve each
    before, rows = {}, []
    for r in counts:
        rows.append((r["curve"], r["part"], before.get(r["curve"], 0)))
        before[r["curve"]] = before.get(r["curve"], 0) + r["count"]
    offsets = spark.createDataFrame(rows, "curve int, part int, before long")  # a row for each curve and partition
    out = stored(line.join(F.broadcast(offsets), ["curve", "part"]).select("curve", "point", "asks", (F.col("place") + F.col("before")).alias("place")), "ann-places")
    discard(line)
    return out


def window_for(truth: list[tuple[np.ndarray, np.ndarray]], most: int, recall: float) -> int:
    """truth: for a query its own places by curve and those of its neighbours (neighbours x curves)."""
    window = LEAST
    while window < most:
        hits = [(np.abs(near // window - own // window) <= 1).any(1).mean() for own, near in truth if len(near)]
        if not hits or np.mean(hits) >= recall:
            return window
        window *= 2
    return window


def search(rows: DataFrame, queries, k: int = K, curves: int = CURVES, recall: float = RECALL, sample: int = SAMPLE, vector: str = "embedding", window: int | None = None) -> DataFrame:
    """queries: a condition on vec_id. To (query_id, rank, vec_id, score): the k nearest found of each query."""
    spark = rows.sparkSession
    parts = partitions(spark)
    rows = valid(rows, vector).withColumn("asks", queries)
    points = rows.groupBy("v").agg(F.min("row").alias("point"), F.max("asks").alias("asks"))
    points = stored(points, "ann-points")
    n = points.count()
    head = points.select(F.size("v").alias("w")).first()
    width = head["w"] if head else 1
    line = ordered(points, width, curves)
    if window is None:
        some = hashed_sample(points.where("asks").select("point", "v"), sample, "point").toPandas()
        window = LEAST
        if len(some) and n > LEAST:
            near = exact(points, some["point"].to_numpy(), np.array(some["v"].tolist()), k + 1).select("q", "point").where("q <> point")
            spots = near.join(line.where("not asks"), "point").select("q", "point", "curve", "place")
            own = line.where("asks").join(near.select(F.col("q").alias("point")).distinct(), "point").select(F.col("point").alias("q"), F.lit(None).cast("long").alias("point"), "curve", "place")
            truth = []
            for _, g in spots.unionByName(own).toPandas().groupby("q"):  # sample * (k + 1) * curves numbers
                mine, others = g[g["point"].isna()], g[g["point"].notna()]
                truth.append((mine.sort_values("curve")["place"].to_numpy(), others.pivot(index="point", columns="curve", values="place").to_numpy()))
            window = window_for(truth, n, recall)
    windows = line.withColumn("window", F.floor(F.col("place") / F.lit(window)))
    seats = windows.groupBy("point").agg(F.collect_list(F.struct("curve", "window", "asks")).alias("seats"))  # two a curve at most
    seated = points.join(seats, "point").select("point", "v", F.explode("seats").alias("s")).select("point", "v", "s.curve", "s.window", "s.asks")
    shares = -(-window // POOL)
    share = F.pmod(F.xxhash64("point"), F.lit(shares)).cast("int")
    pool = seated.where("not asks").select("curve", "window", share.alias("share"), F.lit(0).alias("role"), "point", "v")
    asking = seated.where("asks").select("curve", F.explode(F.array(F.col("window") - 1, F.col("window"), F.col("window") + 1)).alias("window"), F.lit(1).alias("role"), "point", "v")
    asking = asking.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    groups = pool.unionByName(asking).repartition(parts, "curve", "window", "share").sortWithinPartitions("curve", "window", "share", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            v, point = _matrix(batch.column("v")), batch.column("point").to_numpy()
            where = np.stack([batch.column(c).to_numpy() for c in ("curve", "window", "share", "role")], 1)
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1).tolist(), len(where)]
            for a, b in zip(cuts, cuts[1:]):
                if tuple(where[a, :3]) != at:
                    at, ids, vectors = tuple(where[a, :3]), [], []
                if where[a, 3] == 0:
                    ids.append(point[a:b])
                    vectors.append(v[a:b])
                elif ids:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    for q in range(a, b, 256):
                        to = min(b, q + 256)
                        yield _pairs(point[q:to], *_nearest(v[q:to], vectors[0], ids[0], k + 1))

    found = groups.mapInArrow(compare, "q long, point long, score double")
    found = found.groupBy("q", "point").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "point")
    found = stored(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"), "ann-found")
    discard(line)
    named = points.select("point", "v")
    ids = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("row"))).where(F.col("n") <= k + 1)
    ids = ids.join(named, "v").select("point", "row", "vec_id")
    near = found.join(ids, "point").select("q", "row", "vec_id", "score")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "row"))).where(F.col("n") <= k + 1).drop("n")
    asked = rows.where("asks").join(named, "v").select(F.col("point").alias("q"), F.col("vec_id").alias("query_id"), F.col("row").alias("own"))
    pairs = asked.join(near, "q").where("row <> own")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "row"))
    return pairs.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
