"""Self-join of documents on the Jaccard similarity of their word n-grams.

N-grams are runs of five words (A-Z as a-z); a shorter text is one run. MinHash bands find candidates: bands and rows
are chosen for the wanted recall at the threshold, texts are shuffled on band hashes, and every candidate pair is
verified on the full n-gram sets. Equal texts are one class from the start. Buckets with the same members are verified
once. Larger buckets are cut into blocks, and each pair of blocks is a group of its own, so no group exceeds two blocks.
A group emits counts and a spanning forest of its verified links, never its pairs; a pair that meets in several buckets
counts in the least of them. Connected components of the forests are the groups of near copies.

A null text is empty; texts without a word are linked to equal texts only. Equal texts (repeated rows, copies) share
class, group and links. Rows with one doc_id but several texts pool their links under that doc_id. Rows without a
doc_id count as doc_id -2**63. Empty tables give empty results, and extra columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.components import components
from orbweave.llm.storage import discard, partitions, stored, whole
from orbweave.llm.textcols import U, distinct, mix, shingles, slices, words

SIZE = 5
LIKE = 0.8
RECALL = 0.999
BLOCK = 256


def banding(threshold: float = LIKE, recall: float = RECALL, hashes: int = 100) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest false candidates, with which pairs at the threshold are found with
    this probability by at most so many hashes."""
    for rows in range(hashes, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit)) if hit > 1e-12 else hashes + 1
        if bands * rows <= hashes:
            return bands, rows
    return hashes, 1


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key (of the text), bands (empty for a text without words)."""
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=U))
    times, plus = seeds[0::2] | U(1), seeds[1::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"), lower=True)
                values, bounds = shingles(w.hashes(), w.first, size)
                some = np.flatnonzero(np.diff(bounds) > 0)
                found = np.zeros((len(some), bands), np.int64)
                for b in range(bands if len(some) else 0):
                    h = np.full(len(some), b + 1, U)
                    for r in range(b * rows, (b + 1) * rows):
                        h = mix(h * U(31) + np.minimum.reduceat(values * times[r] + plus[r] ^ (values >> U(32)), bounds[some]))
                    found[:, b] = h.astype(np.int64)
                wide = np.zeros(part.num_rows, np.int32)
                wide[some] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(wide)]), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), lists], names=["doc_id", "key", "bands"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key string, bands array<long>")


def text_key(text: str = "text") -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and key of each row, text and key filled."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key().alias("key"))


def named(doc_id: Column, key: Column) -> Column:
    """What a text is called: its doc_id, or a number by its hash."""
    return F.coalesce(doc_id, F.lit(1 << 62) + F.pmod(F.xxhash64(key), F.lit(1 << 62)))


class Group:
    """The texts of one pair of blocks of a bucket."""

    def __init__(self):
        self.ids, self.sets, self.meets, self.sides = [], [], [], []

    def add(self, doc_id: int, values: np.ndarray, meets: list[int], side: int) -> None:
        self.ids.append(doc_id)
        self.sets.append(values)
        self.meets.append(meets)
        self.sides.append(side)

    def links(self, bucket: int, crossing: bool, threshold: float) -> list[tuple[int, int, int]]:
        """(doc_id, least doc_id of its local component, links that count here) of each linked text."""
        k = len(self.ids)
        if k < 2:
            return []
        size = np.array([len(s) for s in self.sets], float)
        both = common(self.sets)
        union = size[:, None] + size[None, :] - both
        near = np.triu(both - threshold * union >= -1e-9, 1)
        if crossing:
            side = np.array(self.sides)
            near &= side[:, None] != side[None, :]
        ids = np.array(self.ids)
        near &= ids[:, None] != ids[None, :]  # a repeated row isn't linked to itself
        root, n = list(range(k)), [0] * k

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        met = [set(m) for m in self.meets]
        for i, j in np.argwhere(near).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
            if min(met[i] & met[j]) == bucket:
                n[i] += 1
                n[j] += 1
        least: dict[int, int] = {}
        linked = near.any(0) | near.any(1)
        for i in np.flatnonzero(linked).tolist():
            r = find(i)
            least[r] = min(least.get(r, self.ids[i]), self.ids[i])
        return [(self.ids[i], least[find(i)], n[i]) for i in np.flatnonzero(linked).tolist()]


def common(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many values each two of the sets share."""
    if len(sets) == 2:
        n = float(len(np.intersect1d(sets[0], sets[1], assume_unique=True)))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    total = int(shared.sum())
    cuts = np.searchsorted(column, np.arange(0, total + width, width))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], column[a:b] - k * width] = 1
        out += m @ m.T
    return out


def verified(tasks: DataFrame, size: int, threshold: float) -> DataFrame:
    """tasks (bucket, i, j, doc_id, text, meets, side), a group's rows together, to (doc_id, other, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, rows = Group(), None, []
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"), lower=True)
                values, bounds = distinct(*shingles(w.hashes(), w.first, size))
                cols = [part.column(c).to_pylist() for c in ("bucket", "i", "j", "doc_id", "meets", "side")]
                for k, (bucket, i, j, doc_id, meets, side) in enumerate(zip(*cols)):
                    if (bucket, i, j) != at:
                        if at is not None:
                            rows += group.links(at[0], at[1] != at[2], threshold)
                        group, at = Group(), (bucket, i, j)
                    group.add(doc_id, values[bounds[k] : bounds[k + 1]].copy(), meets, side)
                if len(rows) > 10_000:
                    yield table(rows)
                    rows = []
        if at is not None:
            rows += group.links(at[0], at[1] != at[2], threshold)
        if rows:
            yield table(rows)

    def table(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "other", "links"])

    return tasks.mapInArrow(run, "doc_id long, other long, links long")


def classes(docs: DataFrame, threshold: float = LIKE, recall: float = RECALL, size: int = SIZE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, texts). rows: doc_id and key of each row of docs. texts: key, text_id (the least doc_id with the text),
    n_copies, n_links (other texts with at least this similarity), group_id (the least doc_id of the component)."""
    bands, rows = banding(threshold, recall)
    docs = identified(docs)
    signed = stored(signatures(docs, size, bands, rows), "ngram-signatures")
    texts = stored(signed.groupBy("key").agg(named(F.min("doc_id"), F.col("key")).alias("text_id"), F.count("*").alias("n_copies"), F.first("bands").alias("bands")), "ngram-texts")
    placed = texts.select("text_id", F.explode("bands").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("text_id").alias("low"), F.bit_xor(F.xxhash64("text_id")).alias("x"), F.bit_xor(F.xxhash64("text_id", F.lit(1))).alias("y"))
    # buckets with the same members are verified once, as the least of them
    buckets = buckets.where("n > 1").groupBy("n", "low", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    meeting = placed.join(buckets, "bucket").groupBy("text_id").agg(F.collect_list(F.struct("bucket", "n")).alias("in"))
    meeting = meeting.join(texts.select("text_id", "key"), "text_id")  # at most one bucket a band: short lists
    meeting = stored(meeting, "ngram-meeting")
    found = docs.select(named(F.col("doc_id"), F.col("key")).alias("text_id"), "key", "text").join(meeting, ["text_id", "key"])
    each = found.select(F.col("text_id").alias("doc_id"), "text", F.col("in.bucket").alias("meets"), F.explode("in").alias("b"))
    each = each.select("doc_id", "text", "meets", F.col("b.bucket").alias("bucket"), F.greatest(F.lit(1), F.ceil(F.col("b.n") / F.lit(block))).cast("int").alias("blocks"))
    each = each.withColumn("own", F.pmod(F.xxhash64("doc_id", "bucket"), F.col("blocks")).cast("int"))
    each = each.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = each.select("bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "doc_id", "text", "meets", F.col("own").alias("side"))
    tasks = tasks.repartition(partitions(docs.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "doc_id")
    linked = stored(verified(tasks, size, threshold), "ngram-links")
    discard(meeting)
    roots = components(linked.select(F.col("doc_id").alias("a"), F.col("other").alias("b")))
    links = linked.groupBy("doc_id").agg(F.sum("links").alias("n_links")).withColumnRenamed("doc_id", "text_id")
    texts = texts.drop("bands").join(links, "text_id", "left").join(roots.withColumnsRenamed({"node": "text_id", "root": "group_id"}), "text_id", "left")
    texts = texts.select("key", "text_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "text_id").alias("group_id"))
    return signed.select("doc_id", "key"), texts


def near_copies(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id (the component), text_id (equal texts), n_copies, n_links: one row for each row of docs."""
    rows, texts = classes(docs, **how)
    return rows.join(texts, "key").select("doc_id", F.col("group_id").alias("class_id"), "text_id", "n_copies", "n_links")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """Of each component the document with the least doc_id; of repeated rows one, of several texts under that doc_id each."""
    _, texts = classes(docs, **how)
    keep = texts.where("text_id = group_id").select("text_id", F.col("key").alias("kept"))
    rows = whole(docs, text_id=named(F.col("doc_id").cast("long"), text_key()), key=text_key()).join(keep, "text_id").where("key = kept")
    first = F.row_number().over(Window.partitionBy("text_id", "key").orderBy("text_id"))
    return rows.withColumn("n", first).where("n = 1").select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs on full n-gram sets, for one language of SQL: words are split at white space, A-Z as a-z.
SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS text_id,
         count(*) OVER (PARTITION BY coalesce(text, '')) AS n_copies
  FROM documents),
w AS (
  SELECT text_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM t WHERE doc_id = text_id),
g AS (
  SELECT DISTINCT text_id, list_aggregate(ws[k : k + 4], 'string_agg', ' ') AS gram
  FROM (SELECT text_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT text_id, count(*) AS n FROM g GROUP BY text_id),
p AS (
  SELECT a.text_id AS a, b.text_id AS b, count(*) AS shared
  FROM g a JOIN g b ON a.gram = b.gram AND a.text_id < b.text_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.text_id = a JOIN n y ON y.text_id = b
  WHERE shared - 0.8e0 * (x.n + y.n - shared) >= -1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (
  SELECT a AS node, a AS root FROM e
  UNION
  SELECT e.b, c.root FROM c JOIN e ON e.a = c.node AND c.root < e.b)
SELECT t.doc_id, coalesce(r.root, t.text_id) AS class_id, t.text_id, t.n_copies, coalesce(d.n, 0) AS n_links
FROM t LEFT JOIN (SELECT node, min(root) AS root FROM c GROUP BY node) r ON r.node = t.text_id
LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) d ON d.a = t.text_id
"""
