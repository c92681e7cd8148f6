"""Language identification with language-bitmask n-gram filters.

The n-grams are runs of three and four bytes of the words between two spaces, A-Z as a-z. Training counts them over all
learning rows; an n-gram belongs to a language in which its share of all n-grams is at least ``least``, which bounds a
language's n-grams by 1/least whatever the input. One bit-sliced Bloom filter holds all languages: a slot is a mask with
a bit for each, and the AND of an n-gram's slots gives all languages that contain it. Executors set the bits, and a
packed row of bits for each language comes to the driver, which puts them side by side. A text's popcounts by language,
corrected for the filter's false positives, and relative to what texts of the language reach, decide.

A null text, or one without a letter, is ``und`` with score 0. Ties go to the first language by name. Rows without a
language are not learned from. With nothing to learn from, all is ``und``. Every row gives one row; repeated rows give
the same, and count as often in learning. A text of any length is judged as a whole. Only doc_id, text and lang are
read, so other columns, whatever their names, play no part. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.storage import discard, stored
from orbweave.llm.textcols import U, Words, mix, slices, words

ORDERS = (3, 4)
HASHES = 3
LEAST = 1e-5


def grams(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the words numbered ``at``, and for each n-gram the place of its word in ``at``."""
    size = w.end[at] - w.start[at]
    wide = size + 2
    bounds = np.concatenate([[0], np.cumsum(wide)])
    owner = np.repeat(np.arange(len(at)), wide)
    inside = np.arange(bounds[-1]) - bounds[owner]
    padded = np.full(bounds[-1] + max(ORDERS), 0x20, np.uint64)
    body = (inside > 0) & (inside <= size[owner])
    padded[: bounds[-1]][body] = w.data[(w.start[at][owner] + inside - 1)[body]]
    found, owners = [], []
    for n in ORDERS:
        code = np.zeros(bounds[-1], np.uint64)
        for k in range(n):
            code = code << U(8) | padded[k : k + bounds[-1]]
        whole = inside + n <= wide[owner]
        found.append(code[whole] | U(n << 56))
        owners.append(owner[whole])
    return np.concatenate(found), np.concatenate(owners)


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, back = np.unique(codes, return_inverse=True)
    return kinds, np.bincount(back, weights=n, minlength=len(kinds)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of docs (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part in slices(batch, most=1 << 19):
                langs = np.array(part.column("lang").to_pylist(), object)
                w = words(part.column("text"), letters=True)
                h, lang = w.hashes(), langs[w.doc]
                for name in set(langs.tolist()):
                    mine = np.flatnonzero(lang == name)
                    _, first, n = np.unique(h[mine], return_index=True, return_counts=True)
                    codes, owner = grams(w, mine[first])
                    got = held.setdefault(name, [])
                    got.append(summed(codes, n[owner]))
                    if len(got) > 4:
                        held[name] = [summed(*map(np.concatenate, zip(*got)))]
        for name, got in held.items():
            codes, n = summed(*map(np.concatenate, zip(*got)))
            for k in range(0, len(codes), 1 << 16):
                c = codes[k : k + (1 << 16)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(c)), pa.array(c), pa.array(n[k : k + (1 << 16)])], names=["lang", "gram", "n"])

    counted = docs.where("lang is not null").select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class LanguageMasks:
    langs: list[str]
    masks: np.ndarray  # slots x words of 64 languages
    wrong: np.ndarray  # false-positive rate by language
    reached: np.ndarray  # the share of its own n-grams that a language's texts have in the filter

    @staticmethod
    def of(table: list[tuple[str, np.ndarray, np.ndarray, int]]) -> LanguageMasks:
        """table: language, its n-grams, their counts, and the count of all n-grams of the language."""
        slots = slots_for(max([len(t[1]) for t in table], default=1))
        return LanguageMasks.beside([(name, np.packbits(bits_of(codes, slots)), float(n.sum() / max(1, total))) for name, codes, n, total in table], slots)

    @staticmethod
    def beside(rows: list[tuple[str, np.ndarray, float]], slots: int) -> LanguageMasks:
        """rows: language, its packed bits, and the share of its n-grams that are in the filter."""
        rows = sorted(rows, key=lambda t: t[0])
        masks = np.zeros((slots, max(1, -(-len(rows) // 64))), U)
        wrong = np.zeros(len(rows))
        for k, (_, packed, _) in enumerate(rows):
            bit = np.unpackbits(packed, count=slots)
            masks[:, k // 64] |= bit.astype(U) << U(k % 64)
            wrong[k] = bit.mean() ** HASHES
        return LanguageMasks([t[0] for t in rows], masks, wrong, np.array([t[2] for t in rows]))

    @staticmethod
    def fit(docs: DataFrame, least: float = LEAST) -> LanguageMasks:
        """Counts over all rows with a language. A language's bits, of at most 1/least n-grams, are set in one task."""
        n = stored(gram_counts(docs), "gram-counts")
        totals = n.groupBy("lang").agg(F.sum("n").alias("total"))
        kept = n.join(totals, "lang").where(F.col("n") >= F.col("total") * least)
        most = kept.groupBy("lang").count().agg(F.max("count")).first()[0]
        slots = slots_for(most or 1)

        def bits(rows: pa.Table) -> pa.Table:
            packed = np.packbits(bits_of(rows.column("gram").to_numpy().astype(U), slots)).tobytes()
            reached = rows.column("n").to_numpy().sum() / rows.column("total")[0].as_py()
            return pa.table({"lang": [rows.column("lang")[0].as_py()], "bits": pa.array([packed], pa.binary()), "reached": [float(reached)]})

        rows = kept.groupBy("lang").applyInArrow(bits, "lang string, bits binary, reached double").collect()  # slots / 8 bytes a language
        discard(n)
        return LanguageMasks.beside([(r["lang"], np.frombuffer(bytes(r["bits"]), np.uint8), r["reached"]) for r in rows], slots)

    def shares(self, w: Words) -> np.ndarray:
        """texts x languages: corrected shares of n-grams that are in the language's filter, relative to the language's
        own texts; a text without n-grams has zeros."""
        n, k = len(w.first) - 1, len(self.langs)
        hits, all_ = np.zeros((n, k)), np.zeros(n)
        if len(w.start) and k:
            _, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
            codes, owner = grams(w, first)
            found = None
            for at in places(codes, len(self.masks)):
                found = self.masks[at] if found is None else found & self.masks[at]
            doc, per_word = w.doc, np.bincount(owner, minlength=len(first)).astype(float)
            all_ = np.bincount(doc, weights=per_word[back], minlength=n)
            for j in range(k):
                bit = (found[:, j // 64] >> U(j % 64) & U(1)).astype(float)
                word_hits = np.bincount(owner, weights=bit, minlength=len(first))
                hits[:, j] = np.bincount(doc, weights=word_hits[back], minlength=n)
        share = hits / np.maximum(all_, 1)[:, None]
        return np.clip((share - self.wrong) / (1 - self.wrong), 0, 1) / np.maximum(self.reached, 1e-9)

    def decide(self, shares: np.ndarray, lettered: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each text, and the best share's part of the best two."""
        if not self.langs:
            return ["und"] * len(shares), np.zeros(len(shares))
        best = shares.argmax(1)
        top = np.sort(shares, axis=1)[:, ::-1]
        second = top[:, 1] if shares.shape[1] > 1 else np.zeros(len(shares))
        score = np.where(top[:, 0] > 0, top[:, 0] / np.maximum(top[:, 0] + second, 1e-12), 1 / max(1, len(self.langs)))
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered)], np.where(lettered, score, 0.0)


def slots_for(most: int) -> int:
    """16 to 32 slots for each n-gram of the language that has the most, a power of two."""
    return 1 << max(10, int(np.ceil(np.log2(16 * max(1, most)))))


def bits_of(codes: np.ndarray, slots: int) -> np.ndarray:
    bit = np.zeros(slots, bool)
    for at in places(codes, slots):
        bit[at] = True
    return bit


def places(codes: np.ndarray, slots: int) -> list[np.ndarray]:
    """The HASHES slots of each n-gram."""
    h = mix(codes)
    a, b = h & U(0xFFFFFFFF), h >> U(32) | U(1)
    return [((a + U(k) * b) % U(slots)).astype(np.int64) for k in range(HASHES)]


def identify(docs: DataFrame, model: LanguageMasks) -> DataFrame:
    """doc_id, lang_pred, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots follow 1/least, not the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, most=1 << 19):
                lang, score = model.decide(model.shares(words(part.column("text"), letters=True)), np.array(part.column("lettered").to_pylist(), bool))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = LanguageMasks.fit(docs.where(fold(3) != 1))
    return identify(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")
