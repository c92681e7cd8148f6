"""BPE encoding and decoding with a pair occurrence index.

Each task gathers the distinct pre-tokens of an Arrow batch into one array of symbols, maps every mergeable pair to all
its positions there, and applies the active ranks in ascending order. A merge touches only the pair's own positions,
and adds the pairs that it makes to the lists of their ranks. Documents then look their pre-tokens up.

Null and empty texts have no ids, and an empty table gives an empty one. Repeated rows are encoded each for itself;
extra columns, whatever their names, are left out. A text of any length is encoded whole; one longer than a slice is a
slice of its own. Of equal ranks in a word the leftmost pair merges first.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from orbweave.llm.textcols import slices

#: Fixed values of the vocabulary file's format: white space of Unicode, and the pattern of pre-tokens.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PRE = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WS}\p{{L}}\p{{N}}]+"
#: Letters and numbers that came with Unicode 16, which the format goes by; the letters first. Later ones are neither.
_NEW_LETTERS = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0"
_NEW_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
CACHE = 300_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves,
    the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + odd.index(b)) for b in range(256)]


@cache
def late_pattern() -> regex.Pattern:
    """The pattern of pre-tokens with the letters and numbers of Unicode 16 spelled out, whatever the regex module knows."""

    def ranges(kind: str, new: str) -> str:
        fixed = {c for r in new.split() for a, b in [r.split("-")] for c in range(int(a, 16), int(b, 16) + 1)}
        all_ = [c for c in range(0x110000) if c in fixed or unicodedata.category(chr(c))[0] == kind]
        starts = [c for k, c in enumerate(all_) if not k or all_[k - 1] != c - 1]
        ends = [c for k, c in enumerate(all_) if k + 1 == len(all_) or all_[k + 1] != c + 1]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))

    letters, numbers = ranges("L", _NEW_LETTERS), ranges("N", _NEW_NUMBERS)
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{_WS}{letters}{numbers}]+")


class PairIndexBPE:
    """A word-end BPE of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        rank = np.arange(len(merges))
        born = dict(zip(self.made.tolist(), rank.tolist()))  # the last rank that makes a symbol
        if any(born.get(x, -1) >= r for xs in (left, right) for x, r in zip(xs.tolist(), rank.tolist())):
            raise ValueError("a pair of this vocabulary ranks before a merge that makes one of its parts")
        order = np.argsort(left << 20 | right)
        self.keys, self.ranks = (left << 20 | right)[order], rank[order]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.marks = sorted({s[:2] for s in self.special})
        self.pre = regex.compile(_PRE)
        self.late = re.compile("[\u0530-\U0010ffff]")  # below it, all versions of Unicode agree

    def pre_tokens(self, text: str) -> list[str]:
        """Special tokens come as they are; all else in lower case, by letters."""
        if self.split and any(m in text for m in self.marks):
            parts = self.split.split(text)
            return [t for k, p in enumerate(parts) for t in ([p] if k % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower case goes by single letters: no final sigma
            text = text.replace("Σ", "σ")
        text = text.lower()
        return (late_pattern() if self.late.search(text) else self.pre).findall(text)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and the n+1 bounds between the words."""
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        stop = np.cumsum(size) - 1
        ids = self.inner[raw]
        filled = stop[size > 0]
        ids[filled] = self.final[raw[filled]]
        n = len(ids)
        sym = np.append(ids, -1)  # the last place is a wall
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[n], prv[0] = n, n
        nxt[filled] = n
        prv[np.append(0, filled[:-1] + 1)[: len(filled)]] = n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(rank: np.ndarray, at: np.ndarray) -> None:
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, places in zip(rank[np.append(0, cuts)].tolist() if len(rank) else (), np.split(at, cuts)):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(places)

        add(self._rank(sym[:n], sym[nxt[:n]]), np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(index.pop(r)))
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
            if a == b and len(at):  # of overlapping pairs every second one, from the left
                chained = np.append(False, nxt[at[:-1]] == at[1:])
                begins = np.flatnonzero(~chained)
                at = at[(np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = self.made[r], -1
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            add(np.concatenate([self._rank(sym[before], sym[at]), self._rank(sym[at], sym[after])]), np.concatenate([before, at]))
        live = sym[:n] >= 0
        bounds = np.append(0, np.cumsum(size))
        return sym[:n][live], np.append(0, np.cumsum(live))[bounds] if n else np.zeros(len(words) + 1, np.int64)

    def table(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """For each word its ids as little-endian 32-bit integers, and its tokens joined by spaces."""
        ids, bounds = self.encode_words([w.encode() for w in words])
        raw, cuts, names = ids.astype("<u4").tobytes(), bounds.tolist(), self.names
        ids = ids.tolist()
        return {w: (raw[4 * a : 4 * b], " ".join([names[i] for i in ids[a:b]]).encode()) for w, a, b in zip(words, cuts, cuts[1:])}

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)


class Encoder:
    """Keeps what earlier batches of a task have encoded, up to CACHE words."""

    def __init__(self, path: str):
        self.bpe, self.ids, self.text = PairIndexBPE(path), {}, {}

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as bytes, decoded text as UTF-8) of each text."""
        split = [self.bpe.pre_tokens(t) if t else [] for t in texts]
        if len(self.ids) > CACHE:
            self.ids, self.text = {}, {}
        new = [w for w in {w for ws in split for w in ws} if w not in self.ids]
        for w, (i, t) in self.bpe.table([w for w in new if w not in self.bpe.special]).items():
            self.ids[w], self.text[w] = i, t
        for w in new:
            if w in self.bpe.special:
                self.ids[w], self.text[w] = self.bpe.special[w].to_bytes(4, "little"), w.encode()
        for ws in split:
            yield b"".join([self.ids[w] for w in ws]), b" ".join([self.text[w] for w in ws])


def encode(docs: DataFrame, vocabulary: str | None = None, *, keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) and decoded of each document.

    vocabulary: a tokenizers JSON file that every executor has at this path; by default the public word_bpe_49k.json.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    fields = ["doc_id long", "n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * keep_ids + ["decoded string"] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                ids, texts = zip(*coder(part.column("text").to_pylist()))
                sizes = [len(i) // 4 for i in ids]
                out = [part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64())]
                out += [pa.array([hashlib.sha256(x).hexdigest() for x in col]) for col in (ids, texts)]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                if keep_text:
                    out.append(pa.array([t.decode() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[f.split(" ")[0] for f in fields])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)
