"""Importance resampling towards a target distribution, in DataFrame functions alone.

Features are runs of consecutive words, told apart by the crc32 of their bytes modulo a number of buckets. Bucket counts
of the corpus and of the target texts give each bucket a gain; a document weighs the sum of its features' gains, a draw
from the exponential family is added to it (Gumbel noise from a hash of the id), and the highest scores are drawn: a sample
without replacement whose odds follow the weights.

Features are exploded and counted where they stand: only bucket counts, a row for each bucket and task, and one sum for
each document are shuffled. The gain table has ``buckets`` rows, which bounds what is broadcast. Ranks come from one range
sort: rows number themselves within their range, and the ranges' sizes, a number each, give the offsets.

Null and empty texts have no features and weigh 0. Rows are told apart by their place in the table, so repeated rows and
rows that share an id, or have none, are scored and drawn each for itself; a null id is hashed as an empty string and comes
before others, and ties of score and id go by a hash of the text. An empty target, like an empty corpus, counts 0 in every
bucket. Texts of any length are taken whole. Only doc_id and text are read, so other columns play no part.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.storage import stored

#: Words once A-Z are lower case: runs of a-z, 0-9 and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Bits of monotonically_increasing_id that number the rows of a partition.
_OWN_BITS = 33


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))


def runs(ws: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` words, joined by a space: those of k words are those of k - 1 and the word after each."""
    found = [ws]
    for k in range(2, longest + 1):
        n = F.greatest(F.size(ws) - (k - 1), F.lit(0))
        found.append(F.zip_with(F.slice(found[-1], F.lit(1), n), F.slice(ws, F.lit(k), n), lambda x, y: F.concat(x, F.lit(" "), y)))
    return F.concat(*found) if longest > 1 else ws


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def counts(rows: DataFrame, name: str, buckets: int, longest: int) -> DataFrame:
    """bucket and how often it is met in the texts."""
    each = rows.select(F.explode(runs(words(F.col("text")), longest)).alias("feature"))
    return each.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket and gain, for all buckets: by how much the target has it more often, on a log scale in thousandths."""
    spark = docs.sparkSession
    table = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for rows, name in ((docs, "s"), (target, "t")):
        table = table.join(counts(rows, name, buckets, longest), "bucket", "left").na.fill(0, [name])
    table = stored(table, "resampling-buckets")
    both = table.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    up = (F.col("t") + 1) * (F.col("all_s") + buckets).cast("double")
    down = (F.col("s") + 1) * (F.col("all_t") + buckets).cast("double")
    return table.join(both).select("bucket", F.floor(1000 * F.ln(up / down)).cast("long").alias("gain"))  # one row of sums


def weighed(docs: DataFrame, gain: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight, text_hash and row, its place in the table, of each row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("ws"))
    own = own.withColumn("n_words", F.size("ws").cast("long"))
    n_features = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(1, longest)), F.col("n_words"))
    # no array beside the exploded one: it would be copied into every row
    each = own.select("row", "doc_id", "text_hash", "n_words", n_features.alias("n_features"), runs(F.col("ws"), longest).alias("features"))
    each = each.select("row", "doc_id", "text_hash", "n_words", "n_features", F.explode_outer("features").alias("feature"))
    each = each.select("row", "doc_id", "text_hash", "n_words", "n_features", bucket(F.col("feature"), buckets).alias("bucket"))
    each = each.join(F.broadcast(gain), "bucket", "left")  # a row for each bucket
    keys = ["row", "doc_id", "text_hash", "n_words", "n_features"]
    return each.groupBy(*keys).agg(F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows with ``rank``: of those with least_words and more, percent in a hundred with the highest scores have their
    place in this order. ``row`` parts equal rows, so that a range is never of one key."""
    order = [F.desc("counts"), F.desc("score"), F.asc("doc_id"), F.asc("text_hash"), F.asc("row")]
    rows = scored.withColumn("counts", F.col("n_words") >= least_words)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("range", F.shiftright("at", _OWN_BITS).cast("int")).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << _OWN_BITS) - 1))), "resampling-order")
    sizes = rows.groupBy("range").agg(F.count_if("counts").alias("n")).orderBy("range").collect()  # a row for each partition
    before, table = 0, []
    for range_, n in sizes:
        table.append((range_, before))
        before += n
    take = percent * before // 100
    offsets = F.broadcast(rows.sparkSession.createDataFrame(table, "range int, before long"))
    place = F.col("before") + F.col("at") + 1
    return rows.join(offsets, "range").withColumn("rank", F.when(F.col("counts") & (place <= take), place)).drop("range", "at", "before", "counts")


def resampled(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs."""
    rows = weighed(docs, gains(docs, target, buckets, longest), buckets, longest)
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(rows, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: crc32 is spelled out over the bytes of each distinct word.
SQL = r"""
WITH RECURSIVE steps AS (
    SELECT i AS byte, i AS v, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT byte, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY byte) AS tab FROM steps WHERE k = 8),
doc_words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
target_words AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
d AS (SELECT r, unnest(ws) AS w FROM doc_words),
t AS (SELECT unnest(ws) AS w FROM target_words),
distinct_words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM d UNION SELECT w FROM t)),
hashed AS (
    SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
        lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 10000 AS bucket FROM distinct_words, crc),
s_counts AS (SELECT bucket, count(*) AS s FROM d JOIN hashed USING (w) GROUP BY bucket),
t_counts AS (SELECT bucket, count(*) AS t FROM t JOIN hashed USING (w) GROUP BY bucket),
gain AS (
    SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM t) + 10000))))::BIGINT AS gain
    FROM (SELECT range AS bucket FROM range(10000)) b LEFT JOIN s_counts USING (bucket) LEFT JOIN t_counts USING (bucket)),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM d JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (
    SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM doc_words LEFT JOIN weights USING (r)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored s LEFT JOIN placed USING (doc_id)
"""
