"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

Tokens are words (A-Z as a-z) and one end for each text. Symbols are the end, the most frequent words, and buckets that
the other words fall in by their last two bytes; within a bucket a word has its smoothed share of the bucket's training
tokens, so every text has a normalised probability. A symbol is predicted from the three before it: their vectors,
weighted by position, add up to one that is multiplied with class vectors and then with the vectors of the symbols in
the class. Symbols are dealt to 32 classes of 64, so a token costs 96 products and exponentials instead of 2048.

Training starts from a bounded sample on the driver (``sample`` whole texts of SAMPLE_BYTES together), which gives all
shards one basin. Then all learning texts are dealt by hash to shards of about SHARD tokens, each shard trains its own
copy in the order of the hashes, and the parameters are averaged in Spark, weighted by tokens; how the table lies in
files and partitions plays no part. A step draws its noise from the unigram distribution, DRAWS times for the classes
and for each class's symbols. Scoring is by batched matrix products with explicit normalisation.

Counts cover all learning texts and stay distributed. A text's rarer words meet their counts in one shuffle of packed
arrays by word hash, and only sums come back. Words are told apart by 64-bit hashes.

An empty table gives an empty one. Null and empty texts have one token, the end. Each row gives one row; repeated rows
score alike, and count as often in learning. A text of any length is scored whole. With nothing to learn from, N = V =
0. Only doc_id and text are read, so other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.lang_masks import fold, summed
from orbweave.llm.storage import bounded_texts, hashed_sample, partitions, stored
from orbweave.llm.textcols import U, Words, mix, slices, words

BUCKETS = 512
SYMBOLS = 2048
CLASSES = 32
WIDE = SYMBOLS // CLASSES
DIM = 16
CONTEXT = 3
NOISE = 16.0
#: Draws of noise that the tokens of a step share.
DRAWS = 256
SAMPLE = 2000
#: Tokens of a shard.
SHARD = 2_000_000
#: The least part of all tokens that a frequent word has.
SHARE = 1e-6
BATCH = 8192
END = np.int64(-1)


def bucket_of(w: Words) -> np.ndarray:
    last = np.maximum(w.end - 1, 0)
    before = np.maximum(w.end - 2, w.start)
    if not len(last):
        return np.zeros(0, np.int32)
    return (mix(w.data[before].astype(U) << U(8) | w.data[last].astype(U)) % U(BUCKETS)).astype(np.int32)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), bucket, n over all texts; the ends of texts are the word -1 in bucket -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        buckets: list[tuple[np.ndarray, np.ndarray]] = []
        ends = 0
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"), lower=True)
                kinds, first, n = np.unique(w.hashes(), return_index=True, return_counts=True)
                held.append((kinds, n))
                buckets.append((kinds, bucket_of(w)[first]))
                ends += part.num_rows
                if len(held) > 12:
                    held, buckets = [summed(*map(np.concatenate, zip(*held)))], [once(buckets)]
        if held:
            kinds, n = summed(*map(np.concatenate, zip(*held)))
            bucket = once(buckets)[1]
            for k in range(0, len(kinds), 1 << 16):
                at = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(kinds[at].astype(np.int64)), pa.array(bucket[at]), pa.array(n[at])], names=["word", "bucket", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([int(END)]), pa.array([-1], pa.int32()), pa.array([ends])], names=["word", "bucket", "n"])

    def once(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        kinds, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        return kinds, np.concatenate([p[1] for p in parts])[first]

    return docs.select("text").mapInArrow(run, "word long, bucket int, n long").groupBy("word", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    heads: np.ndarray  # hashes of the frequent words, ascending
    head_n: np.ndarray
    bucket_n: np.ndarray
    bucket_kinds: np.ndarray
    ends: int
    tokens: int
    kinds: int

    @staticmethod
    def of(counts: DataFrame) -> Vocabulary:
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("bucket") < 0, F.col("n"))), F.lit(0))).first()
        often = counts.where((F.col("bucket") >= 0) & (F.col("n") >= total[0] * SHARE))  # 1 / SHARE words at most
        top = often.orderBy(F.desc("n"), "word").limit(SYMBOLS - BUCKETS - 1).select("word", "n").toPandas()
        heads, n = top["word"].to_numpy(np.int64).astype(U), top["n"].to_numpy(np.int64)
        order = np.argsort(heads)
        heads, n = heads[order], n[order]
        rest = counts.where("bucket >= 0").join(F.broadcast(counts.sparkSession.createDataFrame(pd.DataFrame({"word": heads.astype(np.int64)}), "word long")), "word", "left_anti")
        stats = rest.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()
        bucket_n, bucket_kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
        bucket_n[stats["bucket"]], bucket_kinds[stats["bucket"]] = stats["n"], stats["kinds"]
        return Vocabulary(heads, n, bucket_n, bucket_kinds, total[2], total[0], total[1])

    def symbols(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word, and whether it is a head."""
        h = w.hashes()
        bucket = bucket_of(w) + (SYMBOLS - BUCKETS)
        if not len(self.heads):
            return bucket, np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.heads, h), len(self.heads) - 1)
        head = self.heads[at] == h
        return np.where(head, at + 1, bucket), head

    def shares(self) -> np.ndarray:
        """Unigram distribution of the symbols."""
        n = np.zeros(SYMBOLS)
        n[0] = self.ends
        n[1 : len(self.head_n) + 1] = self.head_n
        n[SYMBOLS - BUCKETS :] = self.bucket_n
        return (n + 0.5) / (n + 0.5).sum()


def sequence(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols with an end after each text, the n+1 bounds of texts, and for each token the CONTEXT symbols before
    it (before a text's first, ends)."""
    n = len(first) - 1
    bounds = first + np.arange(n + 1)
    seq = np.zeros(bounds[-1], np.int32)
    seq[np.arange(len(symbols)) + np.repeat(np.arange(n), np.diff(first))] = symbols
    inside = np.arange(len(seq)) - np.repeat(bounds[:-1], np.diff(bounds))
    before = np.zeros((CONTEXT, len(seq)), np.int32)
    for k in range(CONTEXT):
        before[k, k + 1 :] = seq[: len(seq) - k - 1]
        before[k, inside <= k] = 0
    return seq, bounds, before


def deal(share: np.ndarray) -> np.ndarray:
    """Each symbol's place: class * WIDE + number in the class. Dealt by frequency, so classes weigh about the same."""
    place = np.empty(SYMBOLS, np.int32)
    rank = np.empty(SYMBOLS, np.int64)
    rank[np.argsort(-share, kind="stable")] = np.arange(SYMBOLS)
    place[:] = rank % CLASSES * WIDE + rank // CLASSES
    return place


class Bilinear:
    """vectors of symbols in context, weights by position, class vectors and symbol vectors with their biases."""

    NAMES = ("context", "position", "classes", "class_bias", "symbols", "bias")

    def __init__(self, share: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.place = deal(share)
        noise = np.empty(SYMBOLS)
        noise[self.place] = share
        noise = noise.reshape(CLASSES, WIDE)
        self.class_noise = noise.sum(1)
        self.noise = noise / noise.sum(1, keepdims=True)
        f = np.float32
        self.context = rng.normal(0, 0.3, (SYMBOLS, DIM)).astype(f)
        self.position = np.array([[1.0], [0.7], [0.5]][:CONTEXT], f) * np.ones((1, DIM), f)
        self.classes = rng.normal(0, 0.1, (CLASSES, DIM)).astype(f)
        self.class_bias = np.log(self.class_noise).astype(f)
        self.symbols = rng.normal(0, 0.1, (CLASSES, WIDE, DIM)).astype(f)
        self.bias = np.log(self.noise).astype(f)
        self.seen = {k: np.full_like(getattr(self, k), 1e-8) for k in self.NAMES}

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, v: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, v[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def hidden(self, before: np.ndarray) -> np.ndarray:
        h = self.context[before[0]] * self.position[0]
        for k in range(1, CONTEXT):
            h += self.context[before[k]] * self.position[k]
        return h

    def log10s(self, seq: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol given those before it."""
        h, place = self.hidden(before), self.place[seq]
        cls, own = place // WIDE, place % WIDE
        s = h @ self.classes.T + self.class_bias
        out = s[np.arange(len(s)), cls] - _logsumexp(s)
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            at = order[cuts[c] : cuts[c + 1]]
            if len(at):
                s = h[at] @ self.symbols[c].T + self.bias[c]
                out[at] += s[np.arange(len(at)), own[at]] - _logsumexp(s)
        return out.astype(float) / np.log(10)

    def step(self, seq: np.ndarray, before: np.ndarray, rate: float, rng: np.random.Generator) -> None:
        """One AdaGrad step on the contrastive loss of these tokens."""
        n = len(seq)
        drawn = rng.multinomial(DRAWS, self.class_noise / self.class_noise.sum())
        h, place = self.hidden(before), self.place[seq]
        cls, own = place // WIDE, place % WIDE
        g = _contrast(h @ self.classes.T + self.class_bias, self.class_noise, drawn, cls)
        grads = {"classes": g.T @ h, "class_bias": g.sum(0), "symbols": np.zeros_like(self.symbols), "bias": np.zeros_like(self.bias)}
        back = g @ self.classes
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            at = order[cuts[c] : cuts[c + 1]]
            if len(at):
                mine = h[at]
                drawn = rng.multinomial(DRAWS, self.noise[c] / self.noise[c].sum())
                g = _contrast(mine @ self.symbols[c].T + self.bias[c], self.noise[c], drawn, own[at])
                grads["symbols"][c], grads["bias"][c] = g.T @ mine, g.sum(0)
                back[at] += g @ self.symbols[c]
        ctx = np.zeros((DIM, SYMBOLS))
        pos = np.zeros_like(self.position)
        for k in range(CONTEXT):
            pos[k] = (back * self.context[before[k]]).sum(0)
            weighted = (back * self.position[k]).T
            for d in range(DIM):
                ctx[d] += np.bincount(before[k], weights=weighted[d], minlength=SYMBOLS)
        grads["context"], grads["position"] = ctx.T.astype(np.float32), pos
        for k, d in grads.items():
            d = d / n
            seen = self.seen[k]
            seen += d * d
            getattr(self, k)[...] += rate * d / np.sqrt(seen)

    def learn(self, seq: np.ndarray, before: np.ndarray, rate: float, rng: np.random.Generator, batch: int = BATCH) -> None:
        for k in range(0, len(seq), batch):
            self.step(seq[k : k + batch], before[:, k : k + batch], rate, rng)


def _logsumexp(s: np.ndarray) -> np.ndarray:
    top = s.max(1)
    return top + np.log(np.exp(s - top[:, None]).sum(1))


def _contrast(s: np.ndarray, noise: np.ndarray, drawn: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The gradient of log sigma(d) for the token, and of NOISE times the mean of log sigma(-d) over the noise that was
    drawn (times by symbol), d the score less the log of NOISE * noise."""
    sigma = 1 / (1 + np.exp(np.log(NOISE * noise).astype(np.float32) - s))
    g = sigma * (-NOISE / drawn.sum() * drawn).astype(np.float32)
    rows = np.arange(len(hit))
    g[rows, hit] += 1 - sigma[rows, hit]
    return g


def fit(learn: DataFrame, vocabulary: Vocabulary, sample: int = SAMPLE, rate: float = 0.3, shard: int = SHARD) -> Bilinear:
    """learn: doc_id, text."""
    model = Bilinear(vocabulary.shares())
    first = bounded_texts(hashed_sample(learn.select("doc_id", "text"), sample, "doc_id")).select(["text"])
    parts = [p for b in first.combine_chunks().to_batches() for p in slices(b, most=1 << 19)]
    epochs, rng = 2, np.random.default_rng(3)
    for k in range(12):
        done = 0
        for p in parts if k < epochs else ():
            w = words(p.column("text"), lower=True)
            seq, _, before = sequence(vocabulary.symbols(w)[0], w.first)
            model.learn(seq, before, rate, rng, 1024)
            done += len(seq)
        epochs = epochs if k else 2_000_000 // max(1, done)  # small samples are gone over more often
    spark = learn.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, model.vector()))  # of fixed size
    chunk = 1 << 13
    shards = max(1, vocabulary.tokens // shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, start = shared.value
        at, model = None, None
        for shard, text in _runs(batches):
            if shard != at:
                if at is not None:
                    yield emit(at, model, tokens)
                at, tokens, model, rng = shard, 0, Bilinear(vocabulary.shares()), np.random.default_rng(shard)
                model.load(start)
            w = words(text, lower=True)
            seq, _, before = sequence(vocabulary.symbols(w)[0], w.first)
            model.learn(seq, before, rate, rng)
            tokens += len(seq)
        if at is not None:
            yield emit(at, model, tokens)

    def emit(shard: int, model: Bilinear, tokens: int) -> pa.RecordBatch:
        v = model.vector().astype(float) * tokens
        blocks = [v[k : k + chunk] for k in range(0, len(v), chunk)]
        n = len(blocks)
        cols = [pa.array([shard % 256] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([float(tokens)] * n), pa.array(blocks, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(cols, names=["team", "block", "tokens", "params"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"team": [0], "block": [pdf["block"].iloc[0]], "tokens": [pdf["tokens"].sum()], "params": [np.sum(np.stack(pdf["params"].to_numpy()), axis=0)]})

    kind = "team int, block int, tokens double, params array<double>"
    h = F.xxhash64("doc_id", "text", F.lit("shard"))
    dealt = learn.select(F.pmod(h, F.lit(shards)).cast("int").alias("shard"), h.alias("h"), "text")
    dealt = dealt.repartitionById(min(shards, 4 * partitions(spark)), "shard").sortWithinPartitions("shard", "h").drop("h")
    sums = dealt.mapInArrow(run, kind).groupBy("team", "block").applyInPandas(add, kind)
    sums = sums.groupBy("block").applyInPandas(add, kind).orderBy("block").toPandas()
    if len(sums):
        model.load(np.concatenate([np.asarray(p) / t for p, t in zip(sums["params"], sums["tokens"])]))
    return model


def _runs(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(shard, texts) of rows that lie by shard: runs of about ``most`` bytes, counted from the shard's first row, so that
    they don't follow the batches."""
    at, held, size = None, [], 0
    for batch in batches:
        shard, text = batch.column("shard").to_numpy(), batch.column("text")
        bytes_ = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        begin = 0
        for k in range(len(shard)):
            if shard[k] != at:
                held.append(text.slice(begin, k - begin))
                if at is not None and sum(map(len, held)):
                    yield at, pa.concat_arrays(held)
                at, held, size, begin = int(shard[k]), [], 0, k
            size += int(bytes_[k])
            if size >= most:
                held.append(text.slice(begin, k + 1 - begin))
                yield at, pa.concat_arrays(held)
                held, size, begin = [], 0, k + 1
        held.append(text.slice(begin))
    if at is not None and sum(map(len, held)):
        yield at, pa.concat_arrays(held)


_ROW = "part int, kind int, slice long, words binary, docs binary, sums binary, extra binary"
_NAMES = [c.split(" ")[0] for c in _ROW.split(", ")]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES)


def _split(h: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each part the places of its hashes, by ascending hash."""
    part = (mix(h) % U(parts)).astype(np.int64)
    order = np.lexsort((h, part))
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.unique(part).tolist():
        yield p, order[cuts[p] : cuts[p + 1]]


def scored(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: Bilinear) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    parts = 2 * partitions(spark)
    shared = spark.sparkContext.broadcast((vocabulary, model))  # of fixed size
    tokens = vocabulary.tokens
    base_log = float(np.log10(tokens + 0.5 * (vocabulary.kinds + 1)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each slice of texts a row with what is known of them, and rows with their rarer words, one for each part."""
        vocabulary, model = shared.value
        bucket_log = np.log10(vocabulary.bucket_n + 0.5 * (vocabulary.bucket_kinds + 1))
        head_log = np.log10(np.concatenate([[vocabulary.ends + 0.5], vocabulary.head_n + 0.5]))
        number = 0
        for batch in batches:
            for piece in slices(batch):
                me = TaskContext.get().partitionId() << 32 | number
                number += 1
                w = words(piece.column("text"), lower=True)
                symbols, head = vocabulary.symbols(w)
                seq, bounds, before = sequence(symbols, w.first)
                n = len(bounds) - 1
                owner = np.repeat(np.arange(n), np.diff(bounds))
                logp = np.concatenate([model.log10s(seq[k : k + BATCH], before[:, k : k + BATCH]) for k in range(0, len(seq), BATCH)])
                rare = seq >= SYMBOLS - BUCKETS
                logp[rare] -= bucket_log[seq[rare] - (SYMBOLS - BUCKETS)]
                score = np.bincount(owner, weights=logp, minlength=n)
                common = np.bincount(owner[~rare], weights=head_log[seq[~rare]], minlength=n)
                known = np.bincount(owner[~rare], weights=(seq[~rare] > 0) | (vocabulary.ends > 0), minlength=n)
                ids = piece.column("doc_id")
                null = np.array(ids.is_null().to_pylist(), bool)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                facts = np.stack([np.diff(bounds).astype(float), known, common, score, null.astype(float)])
                rows = [(me % parts, 2, me, ids.tobytes(), None, facts.tobytes(), None)]
                h = w.hashes()[~head]
                doc = w.doc[~head].astype(np.int32)
                for p, at in _split(h, parts):
                    rows.append((p, 1, me, h[at].tobytes(), doc[at].tobytes(), None, None))
                yield _table(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = (batch.column(c).to_numpy() for c in ("word", "n"))
            rows = [(p, 0, 0, h[at].tobytes(), n[at].tobytes(), None, None) for p, at in _split(h.astype(U), parts)]
            if rows:
                yield _table(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's counts come first; then for each slice the sums over its words in the part."""
        at, held, kinds, logs = None, [], None, None
        for batch in batches:
            out = []
            for part, kind, me, raw, second, facts, _ in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
                if part != at:
                    at, held, kinds = part, [], None
                if kind == 0:
                    held.append((np.frombuffer(raw, U), np.frombuffer(second, np.int64)))
                    continue
                if kind == 2:
                    out.append((0, 2, me, raw, None, facts, None))
                    continue
                if kinds is None:
                    kinds, n = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, U), np.zeros(0))
                    order = np.argsort(kinds)
                    kinds, logs, held = kinds[order], np.log10(n[order] + 0.5), []
                h, doc = np.frombuffer(raw, U), np.frombuffer(second, np.int32)
                place = np.minimum(np.searchsorted(kinds, h), max(0, len(kinds) - 1))
                known = kinds[place] == h if len(kinds) else np.zeros(len(h), bool)
                log = np.where(known, logs[place] if len(kinds) else 0.0, np.log10(0.5))
                some, back = np.unique(doc, return_inverse=True)
                sums = np.stack([np.bincount(back, weights=known), np.bincount(back, weights=log)])
                out.append((0, 1, me, None, some.tobytes(), sums.tobytes(), None))
            if out:
                yield _table(out)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, facts = None, None, None
        for batch in batches:
            for kind, me, raw, docs, sums in zip(*(batch.column(c).to_pylist() for c in ("kind", "slice", "words", "docs", "sums"))):
                if me != at:
                    if at is not None:
                        yield done(ids, facts)
                    at = me
                if kind == 2:  # comes first
                    ids, facts = np.frombuffer(raw, np.int64), np.frombuffer(sums).reshape(5, -1).copy()
                else:
                    some, sums = np.frombuffer(docs, np.int32), np.frombuffer(sums).reshape(2, -1)
                    facts[1, some] += sums[0]
                    facts[2, some] += sums[1]
                    facts[3, some] += sums[1]
        if at is not None:
            yield done(ids, facts)

    def done(ids: np.ndarray, facts: np.ndarray) -> pa.RecordBatch:
        n, known, base, score, null = facts
        cols = [pa.array(ids, mask=null > 0), pa.array(n.astype(np.int64)), pa.array(np.round(known).astype(np.int64)), pa.array(np.full(len(n), tokens, np.int64)), pa.array(base - n * base_log), pa.array(score)]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    looked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(look, _ROW)
    packed = counts.where("bucket >= 0").select("word", "n").mapInArrow(pack, _ROW)
    met = packed.unionByName(looked).repartition(partitions(spark), "part").sortWithinPartitions("part", "kind").mapInArrow(meet, _ROW)
    met = met.repartition(partitions(spark), "slice").sortWithinPartitions("slice", F.desc("kind"))
    return met.mapInArrow(gather, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """Scores docs (doc_id, text) with a model of learn (doc_id, text)."""
    counts = stored(word_counts(learn), "lm-counts")
    vocabulary = Vocabulary.of(counts)
    return scored(docs, counts, vocabulary, fit(learn, vocabulary))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, docs.where(fold(5) != 1))
    return out.withColumn("held_out", fold(5) == 1)
