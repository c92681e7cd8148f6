"""Two tokenizers' tokens of one text, side by side.

A transducer reads both token streams at once. Its state says which side leads and the bytes by which it does; the next
token is one of the other side, and the residual of both is the next state. An empty residual closes a group: there tokens
of both end. Moves are memoised by state and token. Neither vocabulary has a token that crosses a single space between
two characters that are not white space, so groups do not cross it either: a text is cut there into units, a worker
runs the transducer once for each unit it meets, and a text is put together from its units.

Links are the pairs of tokens that share a group; how many documents hold a pair is counted over the whole table. Documents
come in blocks of BLOCK text bytes, each with a dictionary of its pairs. Only dictionaries are shuffled to be counted, one
row for each pair and block, and answered; the answers meet the block's documents again. No group is larger than a block,
or a document.

Texts null, empty, or not given back by either side's tokens have none: zeros and an empty string. Repeated rows count
each for itself, and so do rows without a doc_id; ties for the highest count all count as best. An empty table gives an
empty one. Texts of any length are taken whole, a long one is a block of its own. Only doc_id and text are read, so other
columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.storage import stored
from orbweave.llm.textcols import slices
from orbweave.llm.vocabularies import Coders, coders, default_paths

#: Text bytes of a block.
BLOCK = 4 << 20
#: Units that a worker keeps, and moves of its transducer.
CACHE, MOVES = 300_000, 2_000_000
#: Links of a group that are listed one by one; those of a larger one are counted by its different ids.
WIDE = 4096
#: Pairs of a dictionary in one row.
DICTIONARY = 1 << 16
DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_CUTS = re.compile(r"(?<=\S)(?= \S)")


class Transducer:
    """Cuts two streams of tokens into groups at the bytes where tokens of both end."""

    def __init__(self, a_tokens: list[bytes], b_tokens: list[bytes]):
        self.tokens = (a_tokens, b_tokens)
        self.width = max(len(a_tokens), len(b_tokens))
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple[int, bytes]] = [(1, b"")]  # the side that leads, and its unmatched bytes; 0: none are
        self.known = {(1, b""): 0}
        self.moves: dict[int, int] = {}
        self.waits = [0]  # the side whose token is next

    def move(self, state: int, token: int) -> int:
        """The state after the token; -1 where its bytes differ from the residual."""
        lead, residual = self.states[state]
        side = self.waits[state]
        new = self.tokens[side][token]
        if not new:
            to = -1
        elif residual.startswith(new):
            to = self._named(lead, residual[len(new) :])
        elif new.startswith(residual):
            to = self._named(side, new[len(residual) :])
        else:
            to = -1
        self.moves[state * self.width + token] = to
        return to

    def _named(self, lead: int, residual: bytes) -> int:
        key = (lead, residual) if residual else (1, b"")
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
            self.waits.append(1 - lead)
        return self.known[key]

    def groups(self, a: list[int], b: list[int]) -> np.ndarray | None:
        """How many tokens of either side each group ends after, a row for each; None where the sides differ."""
        if len(self.moves) > MOVES:
            self.clear()
        moves, waits, width = self.moves, self.waits, self.width
        out_i, out_j, i, j, state, n_a, n_b = [], [], 0, 0, 0, len(a), len(b)
        while i < n_a or state:
            if waits[state]:
                if j == n_b:
                    return None
                key = state * width + b[j]
                j += 1
            else:
                if i == n_a:
                    return None
                key = state * width + a[i]
                i += 1
            to = moves.get(key)
            state = self.move(state, key % width) if to is None else to
            if state <= 0:
                if state < 0:
                    return None
                out_i.append(i)
                out_j.append(j)
        return np.array([out_i, out_j], np.int64).T if j == n_b else None


def links(a: np.ndarray, b: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, a * base + b, times) of the pairs in each group; those of a large group are counted by their ids."""
    starts = np.concatenate([np.zeros((1, 2), np.int64), ends[:-1]])
    size = ends - starts
    many = size[:, 0] * size[:, 1]
    small = np.flatnonzero(many <= WIDE)
    n = many[small]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    group = np.repeat(small, n)
    i, j = np.divmod(at, size[group, 1])
    found = [(group, a[starts[group, 0] + i] * base + b[starts[group, 1] + j], np.ones(len(group), np.int64))]
    for g in np.flatnonzero(many > WIDE).tolist():
        (x, cx), (y, cy) = (np.unique(v[s:e], return_counts=True) for v, s, e in zip((a, b), starts[g], ends[g]))
        found.append((np.full(len(x) * len(y), g), (x[:, None] * base + y).ravel(), np.outer(cx, cy).ravel()))
    return tuple(np.concatenate(c) for c in zip(*found))


class Units:
    """What a worker knows of the units it has met: groups, numbers of tokens, and links."""

    def __init__(self, of: Coders):
        self.coders, self.base = of, len(of.piece_tokens)
        self.transducer = Transducer(of.byte_tokens, of.piece_tokens)
        self.clear()

    def clear(self) -> None:
        self.plain: dict[str, int] = {}  # units that have no white space at their ends; -1 for what is none
        self.odd: dict[str, int] = {}
        self.text: list[str | None] = []
        self.sums = np.zeros((0, 4), np.int64)
        self.pairs, self.times, self.bounds = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def of(self, texts: list[str]) -> list[list[int]]:
        """Places of each text's units."""
        if len(self.text) > CACHE:
            self.clear()
        parts = [t.split(" ") for t in texts]
        plain = self.plain
        new = {p for ps in parts for p in ps if p not in plain}
        good = [p for p in new if p and p.strip() == p]
        plain.update(dict.fromkeys(new, -1))
        if good:
            (a, a_bounds), (b, b_bounds) = self.coders(" ".join(good))
            plain.update(zip(good, self._learn(good, a, a_bounds, b, b_bounds)))
        out = [[plain[p] for p in ps] for ps in parts]
        for k, places in enumerate(out):
            if -1 in places:
                pieces = [u[1:] for u in _CUTS.split(" " + texts[k])]
                fresh = [u for u in dict.fromkeys(pieces) if u not in self.odd]
                if fresh:
                    sides = []
                    for ids in zip(*[self.coders.one(u) for u in fresh]):
                        sides += [np.array([x for one in ids for x in one], np.int64), np.append(0, np.cumsum([len(one) for one in ids]))]
                    self.odd.update(zip(fresh, self._learn(fresh, *sides)))
                out[k] = [self.odd[u] for u in pieces]
        return out

    def _learn(self, units: list[str], a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray) -> range:
        """The transducer runs over all units in one go; where the sides differ somewhere, over either half of them."""
        first, n = len(self.text), len(units)
        tokens = self.coders.byte_tokens
        ends = self.transducer.groups(a.tolist(), b.tolist()) if b"".join([tokens[x] for x in a.tolist()]) == "".join([" " + u for u in units]).encode() else None
        if ends is not None:
            last = np.searchsorted(ends[:, 0], a_bounds[1:])
            if (ends[last] != np.stack([a_bounds[1:], b_bounds[1:]], 1)).any():
                ends = None
        if ends is None and n > 1:
            h = n // 2
            self._learn(units[:h], a[: a_bounds[h]], a_bounds[: h + 1], b[: b_bounds[h]], b_bounds[: h + 1])
            self._learn(units[h:], a[a_bounds[h] :], a_bounds[h:] - a_bounds[h], b[b_bounds[h] :], b_bounds[h:] - b_bounds[h])
            return range(first, first + n)
        if ends is None:
            self.text.append(None)
            self.sums, self.bounds = np.concatenate([self.sums, np.zeros((1, 4), np.int64)]), np.append(self.bounds, self.bounds[-1])
            return range(first, first + 1)
        cuts = np.append(0, last + 1)
        sides = [pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends[:, k]), pa.int32()), pa.array(ids).cast(pa.string())), ",") for k, ids in enumerate((a, b))]
        shown = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pc.binary_join_element_wise(*sides, "|"))
        self.text += pc.binary_join(shown, ";").to_pylist()
        group, pair, times = links(a, b, ends, self.base)
        unit = np.repeat(np.arange(n), np.diff(cuts))[group]
        order = np.lexsort((pair, unit))
        pair, unit, times = pair[order], unit[order], times[order]
        heads = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (unit[1:] != unit[:-1])))
        n_links = np.diff(np.append(0, np.cumsum(times))[np.searchsorted(unit, np.arange(n + 1))])
        self.sums = np.concatenate([self.sums, np.stack([np.diff(a_bounds), np.diff(b_bounds), np.diff(cuts), n_links], 1)])
        self.pairs, self.times = np.append(self.pairs, pair[heads]), np.append(self.times, np.add.reduceat(times, heads))
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.searchsorted(unit[heads], np.arange(1, n + 1)))
        return range(first, first + n)


@cache
def units(byte_path: str, piece_path: str) -> Units:
    """One for each Python worker, whatever tasks it has."""
    return Units(coders(byte_path, piece_path))


def _pairs_of(known: Units, places: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, times), by document and pair, of units at these places in documents."""
    wide = len(known.text) + 1
    cell, often = np.unique(doc * wide + places, return_counts=True)
    of, unit = cell // wide, cell % wide
    size = known.bounds[unit + 1] - known.bounds[unit]
    at = np.arange(int(size.sum())) + np.repeat(known.bounds[unit] - np.cumsum(size) + size, size)
    pair, times, own = known.pairs[at], known.times[at] * np.repeat(often, size), np.repeat(of, size)
    order = np.lexsort((pair, own))
    pair, times, own = pair[order], times[order], own[order]
    heads = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (own[1:] != own[:-1]))[: len(pair)])
    return own[heads], pair[heads], np.add.reduceat(times, heads) if len(heads) else times


class _Block:
    """Documents until they are BLOCK bytes of text."""

    def __init__(self):
        self.rows, self.doc, self.pair, self.times, self.bytes = [], [], [], [], 0

    def add(self, known: Units, ids: list[int | None], texts: list[str | None]) -> None:
        some = [k for k, t in enumerate(texts) if t]
        places = dict(zip(some, known.of([texts[k] for k in some])))
        first, flat, owner = len(self.rows), [], []
        for k, doc_id in enumerate(ids):
            mine = places.get(k, [])
            shown = [known.text[p] for p in mine]
            if not mine or None in shown:
                self.rows.append((doc_id, 0, 0, 0, 0, ""))
                continue
            at = np.array(mine, np.int64)
            self.rows.append((doc_id, *known.sums[at].sum(0).tolist(), hashlib.sha256(";".join(shown).encode()).hexdigest()))
            flat.append(at)
            owner.append(np.full(len(at), first + k, np.int64))
        if flat:
            doc, pair, times = _pairs_of(known, np.concatenate(flat), np.concatenate(owner))
            self.doc.append(doc)
            self.pair.append(pair)
            self.times.append(times)
        self.bytes += sum(len(t) for t in texts if t) + 64 * len(texts)

    def batches(self, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row for each document, with its pairs as places in the dictionary, and rows of the dictionary."""
        doc, pair, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.doc, self.pair, self.times))
        names, back, held = np.unique(pair, return_inverse=True, return_counts=True)
        n = len(self.rows)
        bounds = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
        cols = [pa.array([block] * n, pa.int64()), *[pa.array(c, f.type) for c, f in zip(zip(*self.rows), [schema.field(k) for k in range(1, 7)])]]
        cols += [pa.ListArray.from_arrays(bounds, pa.array(back.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(times))]
        yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))], schema=schema)
        for k in range(0, len(names), DICTIONARY):
            part = slice(k, k + DICTIONARY)
            cols = [pa.array([block], pa.int64()), *[pa.nulls(1, schema.field(c).type) for c in range(1, 9)], pa.array([k], pa.int32())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([names[part]], pa.list_(pa.int64())), pa.array([held[part]], pa.list_(pa.int32()))], schema=schema)


def aligned(docs: DataFrame, byte_vocabulary: str | None = None, piece_vocabulary: str | None = None) -> DataFrame:
    """Rows of documents (block, DOC, places, times) and of dictionaries (block, first, pairs, held)."""
    paths = [given or path for given, path in zip((byte_vocabulary, piece_vocabulary), default_paths())]
    kinds = [("block", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("first", pa.int32()), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int32()))]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number, now = units(*paths), TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for part in slices(batch):
                now.add(known, part.column("doc_id").cast(pa.int64()).to_pylist(), part.column("text").to_pylist())
                if now.bytes >= BLOCK:
                    yield from now.batches(number, schema)
                    number, now = number + 1, _Block()
        if now.rows:
            yield from now.batches(number, schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"block long, {DOC}, places array<int>, times array<long>, first int, pairs array<long>, held array<int>")


def counted(dictionaries: DataFrame, base: int) -> DataFrame:
    """pair, held (the documents that hold it) and best: whether no pair of its A id is held by more."""
    total = dictionaries.groupBy("pair").agg(F.sum("held").alias("held"))
    first = Window.partitionBy(F.floor(F.col("pair") / base))  # an A id has no more pairs than B has tokens
    return total.withColumn("best", F.col("held") == F.max("held").over(first))


def alignments(docs: DataFrame, byte_vocabulary: str | None = None, piece_vocabulary: str | None = None) -> DataFrame:
    """DOC and n_best, count_sum of each row. The vocabularies are files that every executor has at these paths: by
    default the public byte_bpe_50k.tiktoken, which has the ids of byte_bpe_50k.json, and piece_bpe_32k.model."""
    import sentencepiece

    base = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary or default_paths()[1]).get_piece_size()
    rows = stored(aligned(docs, byte_vocabulary, piece_vocabulary), "alignment")
    words = rows.where("pairs IS NOT NULL").select("block", "first", F.posexplode(F.arrays_zip("pairs", "held")).alias("k", "z"))
    words = words.select("block", (F.col("first") + F.col("k")).alias("place"), F.col("z.pairs").alias("pair"), F.col("z.held").alias("held"))
    known = counted(words, base)
    answers = words.drop("held").join(known, "pair").select(F.col("block").alias("of_block"), "place", "held", "best")
    own = rows.where("places IS NOT NULL").select("block", *[f.split(" ")[0] for f in DOC.split(", ")], "places", "times")

    def run(mine: pa.Table, told: pa.Table) -> pa.Table:
        held, best = np.zeros(told.num_rows, np.int64), np.zeros(told.num_rows, np.int64)
        at = told.column("place").to_numpy()
        held[at], best[at] = told.column("held").to_numpy(), told.column("best").to_numpy()
        lists = [mine.column(c).combine_chunks() for c in ("places", "times")]
        size = np.diff(lists[0].offsets.to_numpy())
        places, times = (x.flatten().to_numpy() for x in lists)
        ends = np.append(0, np.cumsum(size))
        sums = [np.diff(np.append(0, np.cumsum(times * x[places]))[ends]) for x in (best, held)]
        out = mine.drop_columns(["block", "places", "times"])
        return out.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    return own.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(run, f"{DOC}, n_best long, count_sum long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark.read.parquet(f"{sf_dir}/documents.parquet"))
