"""Words of a whole Arrow batch at once.

A batch of texts is one UTF-8 buffer with offsets. Word bounds come from a byte table, word hashes from
differences of prefix sums of a polynomial modulo 2**64, so no Python object is made for a word.
Words are ``[^\\x20\\x09-\\x0D]+``: both bounds are ASCII, hence byte positions are safe in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_MUL = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: a-z for A-Z, bytes of other scripts as they are, and a space for the rest of ASCII.
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits (the splitmix64 finaliser)."""
    x = np.asarray(x, dtype=U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_MUL))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """m**i and m**-i modulo 2**64 for i up to n."""
    have = _powers.get(0)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        m = np.full(size, _MUL, U)
        m[0] = 1
        inv = np.full(size, pow(_MUL, -1, 1 << 64), U)
        inv[0] = 1
        have = (np.multiply.accumulate(m), np.multiply.accumulate(inv))
        if size <= 1 << 23:  # one huge text leaves no huge table behind
            _powers[0] = have
    return have


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` text bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the n+1 bounds between them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, np.uint8)[offs[0] : offs[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offs - offs[0]


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    offs: np.ndarray  # n+1 bounds of texts
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n+1 bounds of texts, counted in words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every batch."""
        m, inv = powers(len(self.data))
        h = np.zeros(len(self.data) + 1, U)
        np.cumsum(_BYTE[self.data] * m[: len(self.data)], out=h[1:])
        return mix((h[self.end] - h[self.start]) * inv[self.start] + (self.end - self.start).astype(U))


def words(texts: pa.Array, lower: bool = False, letters: bool = False) -> Words:
    """lower: A-Z count as a-z. letters: so they do, and all other ASCII but a-z parts words."""
    data, offs = utf8(texts)
    if lower or letters:
        data = (_LETTERS if letters else _LOWER)[data]
    solid = ~_SPACE[data]
    opens, shuts = solid.copy(), solid.copy()
    inner = np.zeros(len(data) + 1, bool)
    inner[offs] = True  # a word never crosses from one text into the next
    if len(data):
        opens[1:] &= ~(solid[:-1] & ~inner[1:-1])
        shuts[:-1] &= ~(solid[1:] & ~inner[1:-1])
    start, end = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    return Words(data, offs, start, end, np.searchsorted(start, offs))


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words inside a text, and their n+1 bounds; a shorter text that has words
    gives one run of all its words."""
    counts = np.diff(first)
    n = len(hashes)
    m, inv = powers(n)
    h = np.zeros(n + 1, U)
    np.cumsum(hashes * m[:n], out=h[1:])
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    total = int(bounds[-1])
    at = np.arange(total) - np.repeat(bounds[:-1] - first[:-1], runs)
    end = np.minimum(at + size, np.repeat(first[1:], runs))
    return mix((h[end] - h[at]) * inv[at] + (end - at).astype(U)), bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats, with new bounds."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], np.searchsorted(d[keep], np.arange(len(bounds)))
