"""Quality rules from what public vocabularies make of a text.

Words (``[^\\x20\\x09-\\x0D]+``) are encoded, each with a space before it, by a byte-level vocabulary and by one of pieces
with byte fallback. A document has from them: its characters per token under either vocabulary, the share of its pieces
that are single bytes, and the entropy of its pieces. What is usual differs by script, so each script has bands of its
own, and so does each language where the table has a column ``lang``; as the entropy of a text grows with its length, they
are set for each power of two of pieces. A band is the median of all documents of the group that pass the base rules,
and how far they stray from it. A document is rejected where it lies outside of a band of its group.

Every distinct word of a slice is encoded once, and a task keeps what it has encoded up to CACHE words; all else is
numpy over whole Arrow buffers. Bands are grouped approximate percentiles over all documents.

Null texts are empty; texts without a word have zeros, no entropy, and fail the base rules as texts of under 50 words
do. A null lang is one of each script. Repeated rows are judged each for itself and alike, ties with an end of a band are
inside, an empty table gives an empty one, and up to three documents of a group are inside its bands. Texts of any length
are taken whole; one longer than a slice is a slice of its own. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.storage import stored
from orbweave.llm.textcols import Words, mix, powers, shingles, slices, words
from orbweave.llm.vocabularies import coders, default_paths

U = np.uint64
#: Words that a task keeps the tokens of.
CACHE = 300_000
#: The contract's symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Scripts by the first byte of a letter's UTF-8, and the bytes that begin them.
SCRIPTS = ["none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana_han", "hangul", "other"]
_RANGES = [(0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xC9, 1), (0xCE, 0xCF, 2), (0xD0, 0xD4, 3), (0xD7, 0xD7, 4), (0xD8, 0xDB, 5), (0xE0, 0xE0, 6), (0xE3, 0xE9, 7), (0xEA, 0xED, 8), (0xCA, 0xCD, 9), (0xD5, 0xD6, 9), (0xDC, 0xDF, 9), (0xE1, 0xE1, 9), (0xF0, 0xF4, 9)]
_SCRIPT = np.zeros(256, np.int64)
for _a, _b, _k in _RANGES:
    _SCRIPT[_a : _b + 1] = _k

#: How many times the usual distance from the median a band reaches, on either side; None where that side has no end.
REACH = {"chars_per_byte_token": (12.0, None), "chars_per_piece": (12.0, None), "byte_share": (None, 12.0), "entropy": (4.5, None)}
#: The usual distance is never taken as less than this, so that bands of uniform documents are not points.
LEAST = {"chars_per_byte_token": 0.03, "chars_per_piece": 0.03, "byte_share": 0.01, "entropy": 0.05}
#: Rows of bands that are sent to all tasks; more are joined by a shuffle.
SENT = 10_000

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
GROUP = ["kind", "size_class"]
FIELDS = "doc_id long, kind string, " + ", ".join(f"{c} long" for c in BASE) + ", script string, size_class int, n_byte_tokens long, n_pieces long, byte_share double, entropy double"


class Vocabularies:
    """The two vocabularies, and the tokens of words met so far."""

    def __init__(self, byte_path: str, piece_path: str):
        self.coders = coders(byte_path, piece_path)
        self.is_byte = np.array([self.coders.pieces.is_byte(i) for i in range(self.coders.pieces.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.n_bytes = np.zeros(0, np.int64)
        self.ids, self.bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def look_up(self, w: Words, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The places of distinct words with these hashes; ``first`` says where in ``w`` each stands."""
        if len(self.at) > CACHE:
            self.clear()
        have, hs = self.at, hashes.tolist()
        new = [k for k, h in enumerate(hs) if h not in have]
        if new:
            at = first[new]
            size = w.end[at] - w.start[at] + 1
            ends = np.cumsum(size)
            text = w.data[np.minimum(np.arange(ends[-1]) + np.repeat(w.start[at] - ends + size, size), len(w.data) - 1)]
            text[ends - 1] = 0x20
            (_, of_bytes), (ids, bounds) = self.coders(text[:-1].tobytes().decode())
            have.update(zip([hs[k] for k in new], range(len(have), len(have) + len(new))))
            self.n_bytes = np.append(self.n_bytes, np.diff(of_bytes))
            self.ids, self.bounds = np.append(self.ids, ids), np.append(self.bounds, self.bounds[-1] + bounds[1:])
        return np.array([have[h] for h in hs], np.int64)


@cache
def vocabularies(byte_path: str, piece_path: str) -> Vocabularies:
    """One for each Python worker, whatever tasks it has."""
    return Vocabularies(byte_path, piece_path)


def base_measures(w: Words) -> dict[str, np.ndarray]:
    """The contract's counts of each text."""
    n = len(w.offs) - 1
    solid = np.zeros(len(w.data) + 1, np.int8)
    solid[w.start] += 1  # no start comes twice, and no end
    solid[w.end] -= 1
    solid = np.cumsum(solid[:-1], dtype=np.int8).astype(bool)

    def by_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[w.offs])

    return {"n_words": w.counts, "word_chars": by_text(solid & ((w.data & 0xC0) != 0x80)), "n_symbols": by_text(SYMBOLS[w.data]), "n_dup_lines": _dup_lines(w, solid), "n_repeat_words": _repeat_words(w, n)}


def _own(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes told apart by text."""
    return mix(values ^ mix(text.astype(U) + U(1)))


def _dup_lines(w: Words, solid: np.ndarray) -> np.ndarray:
    n = len(w.offs) - 1
    breaks = np.flatnonzero(w.data == 0x0A)
    start = np.concatenate([w.offs[:-1], breaks + 1])
    end = np.concatenate([w.offs[1:], breaks])
    order = np.lexsort((end, start))  # a text that begins with a break has an empty line there, which comes first
    start = start[order]
    end = np.sort(end)
    text = np.clip(np.searchsorted(w.offs, start, "right") - 1, 0, max(n - 1, 0))
    filled = np.append(0, np.cumsum(solid, dtype=np.int64))
    keep = filled[np.maximum(end, start)] > filled[start]
    start, end, text = start[keep], end[keep], text[keep]
    m, inv = powers(len(w.data))
    h = np.zeros(len(w.data) + 1, U)
    np.cumsum(mix(w.data.astype(U) + U(1)) * m[: len(w.data)], out=h[1:])
    lines = _own(mix((h[end] - h[start]) * inv[start] + (end - start).astype(U)), text)
    order = np.argsort(lines, kind="stable")
    again = np.append(False, lines[order][1:] == lines[order][:-1])[: len(order)]
    return np.bincount(text[order][again], minlength=n)


def _repeat_words(w: Words, n: int) -> np.ndarray:
    h, bounds = shingles(w.hashes(), w.first, 3)
    text = np.repeat(np.arange(n), np.diff(bounds))
    at = np.arange(len(h)) - bounds[text] + w.first[text]
    whole = w.counts[text] >= 3
    h, at, text = _own(h[whole], text[whole]), at[whole], text[whole]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order] = np.append(False, same)[: len(h)] | np.append(same, False)[: len(h)]
    covered = np.zeros(int(w.first[-1]), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return np.diff(np.append(0, np.cumsum(covered, dtype=np.int64))[w.first])


def scripts(w: Words) -> np.ndarray:
    """The script of most letters of each text; 0 where there is no letter."""
    n, kinds = len(w.offs) - 1, len(SCRIPTS)
    kind = _SCRIPT[w.data]
    cells = np.repeat(np.arange(n), np.diff(w.offs)) * kinds + kind
    counts = np.bincount(cells, minlength=n * kinds).reshape(n, kinds)
    counts[:, 0] = 0
    return np.where(counts.any(1), counts.argmax(1), 0)


def token_measures(w: Words, vocab: Vocabularies) -> dict[str, np.ndarray]:
    """By text: tokens under either vocabulary, the share of single bytes, entropy in bits, and binary digits of the number
    of pieces."""
    n = len(w.offs) - 1
    hashes = w.hashes()
    distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    place = vocab.look_up(w, distinct, first)
    size = vocab.bounds[place + 1] - vocab.bounds[place]
    text = w.doc
    n_bytes = np.bincount(text, weights=vocab.n_bytes[place][back], minlength=n).astype(np.int64)
    n_pieces = np.bincount(text, weights=size[back], minlength=n).astype(np.int64)
    cell, times = np.unique(text * len(distinct) + back, return_counts=True)  # words of a text with their numbers
    of, word = (cell // len(distinct), cell % len(distinct)) if len(distinct) else (cell, cell)
    many = size[word]
    step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    ids = vocab.ids[np.repeat(vocab.bounds[place[word]], many) + step]
    width = len(vocab.is_byte)
    key = np.repeat(of, many) * width + ids
    order = np.argsort(key, kind="stable")
    key, weight = key[order], np.repeat(times, many)[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    count = np.add.reduceat(weight, heads).astype(np.float64) if len(heads) else np.zeros(0)
    own, piece = key[heads] // width, key[heads] % width
    fallback = np.bincount(own, weights=count * vocab.is_byte[piece], minlength=n)
    spread = np.bincount(own, weights=count * np.log2(np.maximum(count, 1)), minlength=n)
    total = np.maximum(n_pieces, 1)
    entropy = np.maximum(np.log2(total) - spread / total, 0.0)
    return {"n_byte_tokens": n_bytes, "n_pieces": n_pieces, "byte_share": fallback / total, "entropy": entropy, "size_class": np.frexp(total)[1].astype(np.int32)}


def measures(docs: DataFrame, byte_vocabulary: str | None = None, piece_vocabulary: str | None = None) -> DataFrame:
    """FIELDS of each row, and what follows from them. The vocabularies are files that every executor has at these paths: by default the public
    byte_bpe_50k.tiktoken and piece_bpe_32k.model."""
    paths = [given or path for given, path in zip((byte_vocabulary, piece_vocabulary), default_paths())]
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabularies(*paths)
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                script = [SCRIPTS[k] for k in scripts(w).tolist()]
                kind = [f"{k} {s}" if k is not None else s for k, s in zip(part.column("kind").to_pylist(), script)]
                found = base_measures(w) | token_measures(w, vocab) | {"script": script, "kind": kind}
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *[pa.array(found[c]) for c in names[1:]]], names=names)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", lang.alias("kind")).mapInArrow(run, FIELDS)
    rate = lambda n: F.when(F.col(n) > 0, F.col("word_chars") / F.col(n)).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("*", rate("n_byte_tokens").alias("chars_per_byte_token"), rate("n_pieces").alias("chars_per_piece"), failed.alias("base_failed"))


def bands(measured: DataFrame, reach: dict[str, tuple[float | None, float | None]] = REACH) -> DataFrame:
    """GROUP and, for each measure, the low and high end, from the documents that pass the base rules: the median and
    ``reach`` times the usual distance, which is that to the lower or the upper quartile, whichever is further."""
    quarts = measured.where(~F.col("base_failed")).groupBy(*GROUP).agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(c) for c in reach])
    ends = []
    for c, (low, high) in reach.items():
        q = F.col(c)
        usual = F.greatest(q[1] - q[0], q[2] - q[1], F.lit(LEAST[c]))
        ends += [(q[1] - low * usual if low is not None else F.lit(float("-inf"))).alias(f"{c}_low"), (q[1] + high * usual if high is not None else F.lit(float("inf"))).alias(f"{c}_high")]
    return quarts.select(*GROUP, *ends)


def inside(reach: dict[str, tuple[float | None, float | None]] = REACH) -> Column:
    out = F.lit(True)
    for c in reach:
        out &= F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high"))
    return out


def judged(docs: DataFrame, reach: dict[str, tuple[float | None, float | None]] = REACH, **paths: str) -> DataFrame:
    """Each row's measures, base_failed and kept. Measures are stored, as bands need all of them first."""
    rows = stored(measures(docs, **paths), "fertility")
    limits = bands(rows, reach)
    few = limits.limit(SENT + 1).toArrow()
    limits = F.broadcast(rows.sparkSession.createDataFrame(few, limits.schema)) if few.num_rows <= SENT else limits
    kept = ~F.col("base_failed") & F.coalesce(inside(reach), F.lit(False))
    return rows.join(limits, GROUP, "left").withColumn("kept", kept).drop(*[f"{c}_{side}" for c in reach for side in ("low", "high")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *BASE, "base_failed", "kept", "script", "chars_per_byte_token", "chars_per_piece", "byte_share", "entropy")
