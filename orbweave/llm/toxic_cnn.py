"""Toxicity scores from a convolutional text classifier.

A word's vector is the sum of hashed embeddings of the word and of its beginnings and its end; filters of widths one to
three run over the whole text, and each filter's maximum feeds a logistic unit. The net is trained in numpy on the
driver, on a bounded sample of labelled rows (``sample``, half of each label where there are as many, chosen by a hash
of doc_id, and whole texts of SAMPLE_BYTES together), less a quarter of it. All labelled rows that it is not trained on calibrate: counts by language, as told from
the text by language-bitmask filters fitted to the same sample, by bin of the logit and by label are added up in Spark.
For each language the threshold is that with the best F1, with the labels in the proportion that they have over all
labelled rows of the language, those trained on among them, and scores are shifted so that it is at 0.7. Languages with
few texts of a label to calibrate take the threshold of all together, and where these are few as well, it is at even odds.

An empty table gives an empty one. Null and empty texts are scored as texts without words; a text of any length is one
text to all filters. Labels that are null are no labels; a doc_id labelled twice counts with each label. Without labels
of both kinds, every score is the share of label 1 (0 if there are none). Equal texts have equal scores, and a score on
the threshold is toxic. Every row gives one row, repeated or not; rows are carried whole in a struct ``r``, so that
columns named like ours stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from orbweave.llm.lang_masks import LanguageMasks, fold, grams, summed
from orbweave.llm.storage import SAMPLE_BYTES, bounded_texts, hashed_sample, stored, whole
from orbweave.llm.textcols import U, Words, mix, slices, words

BUCKETS = 1 << 18
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
SAMPLE = 6000
CUT = 0.7
#: A threshold is calibrated from so many texts of either label at least.
FEW = 10
#: Bins of the logit's inverse hyperbolic sine for one: a 256th wide around zero, and bounded in number for any logit.
BINS = 256


def features(w: Words) -> np.ndarray:
    """words x 4 rows of the embedding: of the word, its first three and five bytes, and its last four."""
    size = w.end - w.start
    ids = [w.hashes()]
    for kind, begin, n in ((1, w.start, 3), (2, w.start, 5), (3, np.maximum(w.start, w.end - 4), 4)):
        code = np.full(len(size), kind, U)
        for k in range(n):
            inside = begin + k < w.end
            code = code << U(8) | np.where(inside, w.data[np.minimum(begin + k, len(w.data) - 1)] if len(w.data) else 0, 0).astype(U)
        ids.append(mix(code))
    return (np.stack(ids, 1) % U(BUCKETS)).astype(np.int32)


@dataclass
class Net:
    table: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    base: float

    @staticmethod
    def new(seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        return Net(rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32), [rng.normal(0, 0.6, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS], np.zeros(n, np.float32), rng.normal(0, 0.5, n).astype(np.float32), 0.0)

    def maps(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter outputs at every word, and the padded word vectors (two zero rows after each text)."""
        doc = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(doc)) + (WIDTHS[-1] - 1) * doc
        x = np.zeros((len(doc) + (WIDTHS[-1] - 1) * len(counts) + WIDTHS[-1], DIM), np.float32)
        v = self.table[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            v += self.table[ids[:, k]]
        x[at] = v
        out = np.empty((len(doc), FILTERS * len(WIDTHS)), np.float32)
        for j, w in enumerate(self.filters):
            part = out[:, j * FILTERS : (j + 1) * FILTERS]
            full = x @ w[0]
            for k in range(1, len(w)):
                full[: len(full) - k] += (x @ w[k])[k:]
            part[:] = full[at]
        return out, x

    def pooled(self, out: np.ndarray, counts: np.ndarray) -> np.ndarray:
        peak = np.zeros((len(counts), out.shape[1]), np.float32)
        some = counts > 0
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        if some.any():
            peak[some] = np.maximum.reduceat(out, first[some], axis=0)
        return peak

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out, _ = self.maps(ids, counts)
        return np.maximum(self.pooled(out, counts) + self.bias, 0) @ self.out + self.base


def common(ids: np.ndarray, counts: np.ndarray, least: int = 4) -> np.ndarray:
    """The rows of the embedding that ``least`` texts use; the others stay zero, as they would only be learned by heart."""
    first = np.concatenate([[0], np.cumsum(counts)])
    n = np.zeros(BUCKETS, np.int64)
    for a in range(0, len(counts), 512):
        some = counts[a : a + 512]
        doc, mine = np.repeat(np.arange(len(some)), some), ids[first[a] : first[a + len(some)]]
        for k in range(ids.shape[1]):
            n += np.bincount(np.unique(doc * BUCKETS + mine[:, k]) % BUCKETS, minlength=BUCKETS)
    return n >= least


def train(ids: np.ndarray, counts: np.ndarray, label: np.ndarray, steps: int = 1500, batch: int = 32, rate: float = 0.05, seed: int = 7) -> Net:
    """AdaGrad on the logistic loss; only the words at a filter's maximum get gradients. At least 8 epochs, and of small
    samples as many as make ``steps`` batches, 80 at most."""
    net, rng = Net.new(seed), np.random.default_rng(seed)
    first = np.concatenate([[0], np.cumsum(counts)])
    known = common(ids, counts)
    net.table[~known] = 0
    pos = max(1e-6, label.mean())
    net.base = float(np.log(pos / max(1e-6, 1 - pos)))
    seen = np.full(BUCKETS, 1e-4, np.float32)
    sums = [np.full_like(w, 1e-3) for w in net.filters] + [np.full_like(net.bias, 1e-3), np.full_like(net.out, 1e-3)]
    for _ in range(max(8, min(80, steps * batch // max(1, len(counts))))):
        order = rng.permutation(len(counts))
        for at in np.split(order, range(batch, len(order), batch)):
            at = at[counts[at] > 0]
            if not len(at):
                continue
            n = counts[at]
            rows = np.arange(n.sum()) + np.repeat(first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            mine = ids[rows]
            out, x = net.maps(mine, n)
            peak = net.pooled(out, n)
            lit = np.maximum(peak + net.bias, 0)
            z = lit @ net.out + net.base
            miss = (1 / (1 + np.exp(-z)) - label[at]) / len(at)
            g = miss[:, None] * net.out * (peak + net.bias > 0)  # by text and filter
            doc = np.repeat(np.arange(len(at)), n)
            r, f = np.nonzero(out == peak[doc])
            _, one = np.unique(doc[r] * out.shape[1] + f, return_index=True)
            r, f = r[one], f[one]
            gv, place = g[doc[r], f], r + (WIDTHS[-1] - 1) * doc[r]
            steps = [np.zeros_like(w) for w in net.filters]
            to, by = [], []
            for j, w in enumerate(net.filters):
                own = f // FILTERS == j
                ff, pp, gg = f[own] % FILTERS, place[own], gv[own]
                for k in range(len(w)):
                    np.add.at(steps[j][k].T, ff, gg[:, None] * x[pp + k])
                    word = r[own] + k
                    inside = word < np.cumsum(n)[doc[r[own]]]
                    to.append(word[inside])
                    by.append((gg[:, None] * w[k][:, ff].T)[inside])
            grads = [*steps, g.sum(0), lit.T @ miss]
            for p, s, d in zip([*net.filters, net.bias, net.out], sums, grads):
                s += d * d
                p -= rate * d / np.sqrt(s)
            net.base -= rate * float(miss.sum())
            word, back = np.unique(np.concatenate(to), return_inverse=True)
            d = np.zeros((len(word), DIM), np.float32)
            np.add.at(d, back, np.concatenate(by))
            buckets, where = np.unique(mine[word], return_inverse=True)
            total = np.zeros((len(buckets), DIM), np.float32)
            np.add.at(total, where.reshape(-1), np.repeat(d, mine.shape[1], axis=0))
            buckets, total = buckets[known[buckets]], total[known[buckets]]
            seen[buckets] += (total * total).mean(1)
            net.table[buckets] -= rate * total / np.sqrt(seen[buckets])[:, None]
    return net


def threshold(bins: np.ndarray, counts: np.ndarray, total: np.ndarray) -> float | None:
    """Of the logits between bins that with the best F1; of equal ones the middle. None with few of a label.

    counts: bins x label of the texts to calibrate with; they stand for ``total`` (by label) texts."""
    have = counts.sum(0)
    if have.min() < FEW:
        return None
    kinds, back = np.unique(-bins, return_inverse=True)
    kinds, weight = -kinds, total / have
    n = np.stack([np.bincount(back, weights=counts[:, k], minlength=len(kinds)) for k in (0, 1)], 1) * weight
    above = n.cumsum(0)
    f1 = 2 * above[:, 1] / (above.sum(1) + total[1])
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[len(best) // 2]
    low = kinds[k + 1] + 1 if k + 1 < len(kinds) else kinds[k]  # midway from the upper edge of the next bin
    return float(np.sinh((kinds[k] + low) / 2 / BINS))


@dataclass
class Classifier:
    net: Net | None
    masks: LanguageMasks
    cuts: dict[str, float]
    cut: float
    share: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.share)
        return self.shifted(*self.logits(texts))

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
        """The net's logit of each text and the language it is told to be in."""
        w = words(texts, letters=True)
        return self.net.logits(features(w), w.counts), self.masks.decide(self.masks.shares(w), np.ones(len(texts), bool))[0]

    def shifted(self, z: np.ndarray, lang: list[str]) -> np.ndarray:
        shift = np.array([self.cuts.get(x, self.cut) for x in lang])
        s = 1 / (1 + np.exp(-np.clip(z - shift + np.log(CUT / (1 - CUT)), -30, 30)))
        return np.where(z >= shift, np.maximum(s, CUT), np.minimum(s, np.nextafter(CUT, 0)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> Classifier:
    """docs: doc_id, text, lang, learned from where labels (doc_id, toxic) has them."""
    model, trained = learned(docs, labels, sample, size)
    return model if model.net is None else calibrated(model, logits(docs, model), labels, trained)


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> tuple[Classifier, pa.Array]:
    """The classifier before it is calibrated, and the doc_ids that its net is trained on."""
    known = _known(labels)
    chosen = [hashed_sample(known.where(F.col("toxic") == k), sample // 2, "doc_id") for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most ``sample`` rows
    one = F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("d")  # of rows with one doc_id
    rows = docs.select("doc_id", "text", "lang").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(one)
    rows = bounded_texts(rows.select("doc_id", "toxic", "d.text", "d.lang"), size)
    label = np.array(rows.column("toxic").to_pylist(), float)
    share = float(label.mean()) if len(label) else 0.0
    doc_ids = rows.column("doc_id").combine_chunks()
    if not 0 < label.sum() < len(label):
        return Classifier(None, LanguageMasks.of([]), {}, 0.0, share), doc_ids.slice(0, 0)
    parts = [p for batch in rows.to_batches() for p in slices(batch)]
    masks = LanguageMasks.of(_gram_table(parts))
    ids, counts = [], []
    for p in parts:
        w = words(p.column("text"), letters=True)
        ids.append(features(w))
        counts.append(w.counts)
    del rows, parts, p, w  # the texts
    ids, counts = np.concatenate(ids), np.concatenate(counts)
    held = np.arange(len(label)) % 4 == 0
    ids = ids[~np.repeat(held, counts)]
    net = train(ids, counts[~held], label[~held])
    return Classifier(net, masks, {}, 0.0, share), doc_ids.filter(pa.array(~held)).unique()


def _known(labels: DataFrame) -> DataFrame:
    return labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))


def logits(docs: DataFrame, model: Classifier, carry: bool = False) -> DataFrame:
    """doc_id, told (the language) and z of each row. Texts stay where they are, or with ``carry`` the whole row comes
    along as the struct r."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    rows = whole(docs if carry else docs.select("doc_id", "text"))
    keep = ["r"] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            r = batch.column("r")
            wide = pa.RecordBatch.from_arrays([r, r.field("doc_id"), r.field("text")], names=["r", "doc_id", "text"])
            for part in slices(wide, most=1 << 19):
                z, told = model.logits(part.column("text"))
                cols = [*[part.column(c) for c in keep], part.column("doc_id"), pa.array(told, pa.string()), pa.array(z, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "doc_id", "told", "z"])

    return rows.mapInArrow(run, StructType([*[rows.schema[c] for c in keep], docs.schema["doc_id"], StructField("told", StringType()), StructField("z", DoubleType())]))


def calibrated(model: Classifier, found: DataFrame, labels: DataFrame, trained: pa.Array) -> Classifier:
    """The model with thresholds from all labelled rows of found (logits) but those trained on, which only count in the
    proportion of the labels."""
    by_doc = _known(labels).where("toxic in (0, 1)").groupBy("doc_id").agg(F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1"))
    ids = F.broadcast(found.sparkSession.createDataFrame(pa.table({"doc_id": trained})).withColumn("trained", F.lit(True)))  # at most 2 samples
    z = F.col("z")
    level = F.floor(F.signum(z) * F.log(F.abs(z) + F.sqrt(z * z + 1.0)) * BINS).cast("int")
    rows = found.join(by_doc, "doc_id").join(ids, "doc_id", "left").select("told", "n0", "n1", F.coalesce("trained", F.lit(False)).alias("trained"), level.alias("level"))
    rows = rows.withColumn("level", F.when(F.col("trained"), 0).otherwise(F.col("level")))
    table = rows.groupBy("told", "trained", "level").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # bins of the languages that the masks tell
    told, out = np.array(table.column("told").to_pylist(), object), np.array(table.column("trained").to_pylist(), bool)
    level, n = table.column("level").to_numpy(), np.stack([table.column(c).to_numpy() for c in ("n0", "n1")], 1).astype(float)

    def cut(mine: np.ndarray) -> float | None:
        return threshold(level[mine & ~out], n[mine & ~out], n[mine].sum(0))

    every = cut(np.ones(len(level), bool))
    cuts = {name: t for name in sorted(set(told.tolist())) if (t := cut(told == name)) is not None}
    return replace(model, cuts=cuts, cut=every if every is not None else 0.0)


def _gram_table(parts: list[pa.RecordBatch], least: float = 1e-5) -> list[tuple[str, np.ndarray, np.ndarray, int]]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for p in parts:
        langs, w = np.array(p.column("lang").to_pylist(), object), words(p.column("text"), letters=True)
        lang, h = langs[w.doc], w.hashes()
        for name in {x for x in langs if x is not None}:
            mine = np.flatnonzero(lang == name)
            _, first, n = np.unique(h[mine], return_index=True, return_counts=True)
            codes, owner = grams(w, mine[first])
            codes, n = summed(codes, n[owner])
            if name in held:
                codes, n = summed(np.concatenate([held[name][0], codes]), np.concatenate([held[name][1], n]))
            held[name] = (codes, n)
    return [(name, c[n >= n.sum() * least], n[n >= n.sum() * least], int(n.sum())) for name, (c, n) in sorted(held.items()) if len(c)]


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score, predicted of each row."""
    return scored(docs.select("doc_id", "text"), model).select("r.doc_id", "score", "predicted")


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """r (the row, whole), score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    rows = whole(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            both = pa.RecordBatch.from_arrays([batch.column("r"), batch.column("r").field("text")], names=["r", "text"])
            for part in slices(both, most=1 << 19):
                s = model.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("r"), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], names=["r", "score", "predicted"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> DataFrame:
    """The rows that a classifier fitted to them and their labels doesn't reject, with all their columns and no others.
    Rows are stored with their logits, so that texts are scored once, for the thresholds and for the decision."""
    model, trained = learned(docs, labels, sample, size)
    if model.net is None:
        return docs.where(F.lit(model.share < CUT))
    found = stored(logits(docs, model, carry=True), "logits")
    model = calibrated(model, found.select("doc_id", "told", "z"), labels, trained)
    cut = F.lit(model.cut)
    for name, own in model.cuts.items():
        cut = F.when(F.col("told") == name, F.lit(own)).otherwise(cut)
    return found.where(F.col("z") < cut).select("r.*")


def from_logits(found: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score, predicted of each row of found (logits)."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in batches:
            s = model.shifted(part.column("z").to_numpy(), part.column("told").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return found.mapInArrow(run, StructType([found.schema["doc_id"], StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = labels.where(fold(3) != 1)
    model, trained = learned(docs, learn)
    held_out = (fold(3) == 1).alias("held_out")
    if model.net is None:
        return score(docs, model).select("doc_id", held_out, "score", "predicted")
    found = stored(logits(docs, model), "logits")  # texts are scored once
    return from_logits(found, calibrated(model, found, learn, trained)).select("doc_id", held_out, "score", "predicted")
