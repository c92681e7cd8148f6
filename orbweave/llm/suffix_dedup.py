"""Removal of passages that repeat across documents, with suffix automata of reference shards.

A window is ``length`` consecutive words of one document. A word goes if a window that covers it also starts in a
document with a smaller doc_id. What is removed is judged on the input alone.

Reference text grows with the corpus, so no automaton of it is broadcast to all tasks. Instead content-defined anchors
(the least hashes of ten-word runs, at least one in every window, chosen by the window's words alone) bring a shard of
reference passages and the passages to be matched together by one shuffle: a shard is, for all occurrences of one anchor, the
windows in which it is the least. Within a shard documents stream by in the order of doc_id; each is matched against
the suffix automaton of those before it, and every position where the matching statistic reaches ``length`` ends a
window to remove; what it says anew joins the automaton. An anchor that occurs more than ``shard`` times in different
texts would make a shard without bound; its windows are told by 128-bit hashes instead, each with the least doc_id that has
it, which gives the same spans.

Equal texts are decided once: a copy of a text with a window goes as a whole if a smaller doc_id has the text. Rows with
the same doc_id don't remove each other's words. Null and empty texts have no words. A row without a doc_id is neither
before nor after another: it loses nothing and takes nothing. Empty tables give empty results; extra columns play no
part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.ngram_join import identified, text_key
from orbweave.llm.storage import discard, partitions, stored, whole
from orbweave.llm.textcols import U, Words, mix, powers, slices, words

LENGTH = 50
ANCHOR = 10
SHARD = 512
NOTHING = hashlib.sha256(b"").hexdigest()


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbours."""
    n = len(h)
    m, inv = powers(n)
    p = np.zeros(n + 1, U)
    np.cumsum(h * m[:n], out=p[1:])
    return mix((p[size:] - p[: n - size + 1]) * inv[: n - size + 1]) if n >= size else np.zeros(0, U)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every run of ``width`` neighbours."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(h: np.ndarray, first: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, hash) of each anchor: of all runs of ``size`` words those that are least in a
    window, with the windows, neighbours all, in which they are."""
    wide = length - size + 1
    whole = np.flatnonzero(np.diff(first) >= length)
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    g = runs(h, size)
    low = sliding(g, wide, np.minimum)  # of the window that starts here
    inside = np.zeros(len(low) + 1, np.int64)
    np.add.at(inside, first[whole], 1)
    np.add.at(inside, np.minimum(first[whole + 1] - length + 1, len(low)), -1)
    low = np.where(np.cumsum(inside[:-1]) > 0, low, U(0))
    edge = np.zeros(wide - 1, U)
    low = np.concatenate([edge, low, edge])  # now of the window that ends its last run here
    most = sliding(low, wide, np.maximum)[: len(g)]
    at = np.flatnonzero((most == g) & (most > 0))
    holds = np.stack([low[at + k] == g[at] for k in range(wide)])
    begin = at - wide + 1 + holds.argmax(0)
    text = np.searchsorted(first, at, side="right") - 1
    return text, begin - first[text], holds.sum(0), g[at]


class Automaton:
    """The suffix automaton of sequences of words, set one after another with walls between them."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.last, self.walls = [-1], [0], 0, 0

    def add(self, seq: list[int]) -> None:
        nexts, link, size, last = self.next, self.link, self.size, self.last
        self.walls -= 1
        for c in (*seq, self.walls):
            new = len(nexts)
            nexts.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if size[p] + 1 == size[q]:
                    link[new] = q
                else:
                    twin = len(nexts)
                    nexts.append(nexts[q].copy())
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.last = last

    def statistics(self, seq: list[int]) -> list[int]:
        """For each position the length of the longest match that ends there."""
        nexts, link, size = self.next, self.link, self.size
        v, n, out = 0, 0, []
        for c in seq:
            while v and c not in nexts[v]:
                v = link[v]
                n = size[v]
            to = nexts[v].get(c)
            if to is None:
                n = 0
            else:
                v, n = to, n + 1
            out.append(n)
        return out


def covered(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shard_spans(rows: list[tuple[int, int, int, list[int]]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """rows: (doc_id, text, position of the first word, words) in the order of doc_id. Gives the spans to remove."""
    sam, waiting, seen = Automaton(), [], set()
    at = None
    for doc_id, tid, lo, seq in rows:
        if doc_id != at:
            for w in waiting:
                sam.add(w)
            waiting, at = [], doc_id
        if len(sam.next) > 1:
            stats = sam.statistics(seq)
            ends = [k for k, n in enumerate(stats) if n >= length]
            yield from ((doc_id, tid, lo + a, lo + b) for a, b in covered([(k + 1 - length, k + 1) for k in ends]))
            if stats and stats[-1] == len(seq):
                continue  # the automaton holds all of it
        if (key := tuple(seq)) not in seen:
            seen.add(key)
            waiting.append(seq)


def scanned(docs: DataFrame, length: int, size: int) -> DataFrame:
    """doc_id, key, n_words, whole_sha256, anchors, and for each its first window and how many, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                text, begin, n, g = anchors(w.hashes(), w.first, length, size)
                cuts = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), pa.int32())
                cols = [part.column("doc_id"), part.column("key"), pa.array(w.counts), pa.array(kept_digests(w, None))]
                cols += [pa.ListArray.from_arrays(cuts, pa.array(g.astype(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(begin)), pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int16)))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n_words", "whole_sha256", "anchors", "begins", "windows"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key string, n_words long, whole_sha256 string, anchors array<long>, begins array<long>, windows array<short>")


def kept_texts(w: Words, gone: np.ndarray | None) -> Iterator[bytes]:
    """Each text's words that are not gone, joined by one space."""
    stay = np.ones(len(w.start), bool) if gone is None else ~gone
    start, end = w.start[stay], w.end[stay]
    size = end - start + 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(to[-1], 0x20, np.uint8)
    take = np.ones(to[-1], bool)
    take[to[1:] - 1] = False
    source = np.arange(to[-1]) + np.repeat(start - to[:-1], size)
    out[take] = w.data[source[take]]
    doc = np.searchsorted(np.flatnonzero(stay), w.first)
    raw = out.tobytes()
    for a, b in zip(to[doc[:-1]].tolist(), to[doc[1:]].tolist()):
        yield raw[a : b - 1] if b > a else b""


def kept_digests(w: Words, gone: np.ndarray | None) -> list[str]:
    return [hashlib.sha256(t).hexdigest() for t in kept_texts(w, gone)]


def contexts(involved: DataFrame, length: int) -> DataFrame:
    """involved (doc_id, tid, text, at: begin, code, windows, hot) to one row for each anchor that isn't hot: its passage,
    which is all of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 19):
                w = words(part.column("text"))
                data, out = w.data.tobytes(), ([], [], [], [], [])
                for k, (doc_id, tid, found) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "tid", "at")))):
                    for x in found:
                        if x["hot"]:
                            continue
                        lo = int(w.first[k]) + x["begin"]
                        hi = lo + x["windows"] - 1 + length
                        for col, v in zip(out, (x["code"], doc_id, tid, x["begin"], data[w.start[lo] : w.end[hi - 1]].decode())):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (*[pa.int64()] * 4, pa.string()))], names=["anchor", "doc_id", "tid", "lo", "passage"])

    return involved.select("doc_id", "tid", "text", "at").mapInArrow(run, "anchor long, doc_id long, tid long, lo long, passage string")


_PACKED = "part int, slice long, start long, ones binary, twos binary, lows binary, own binary"
_NAMES = [c.split(" ")[0] for c in _PACKED.split(", ")]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES)


def hot_spans(involved: DataFrame, length: int) -> DataFrame:
    """Spans (doc_id, tid, a, b) of the windows of hot anchors. A slice of texts sends each different window once, as a
    128-bit hash with the least doc_id it has there, packed by parts of the hash range; it gets back the least doc_id of
    all slices."""
    spark = involved.sparkSession
    parts = 2 * partitions(spark)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for piece in slices(batch):
                w = words(piece.column("text"))
                at = [np.arange(x["begin"], x["begin"] + x["windows"]) + w.first[k] for k, found in enumerate(piece.column("at").to_pylist()) for x in found if x["hot"]]
                if not at:
                    continue
                me = TaskContext.get().partitionId() << 32 | number
                number += 1
                at, h = np.unique(np.concatenate(at)), w.hashes()
                one, two = runs(h, length)[at], runs(mix(h + U(1)), length)[at]
                doc = np.searchsorted(w.first, at, side="right") - 1
                ids, tids = (piece.column(c).to_numpy()[doc] for c in ("doc_id", "tid"))
                part = (one % U(parts)).astype(np.int64)
                order = np.lexsort((ids, two, one, part))
                new = np.ones(len(order), bool)
                new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
                kind = np.empty(len(order), np.int64)
                kind[order] = np.cumsum(new) - 1
                first = order[new]
                own = np.stack([ids, tids, at - w.first[doc], kind])
                rows = [(me % parts, me, -1, None, None, None, own.tobytes())]
                cuts = np.searchsorted(part[first], np.arange(parts + 1))
                for p in np.unique(part[first]).tolist():
                    mine = first[cuts[p] : cuts[p + 1]]
                    rows.append((p, me, int(cuts[p]), one[mine].tobytes(), two[mine].tobytes(), ids[mine].astype(np.int64).tobytes(), None))
                yield _packed(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
                if row[0] != at:
                    yield from answered(held)
                    at, held = row[0], []
                held.append(row)
        yield from answered(held)

    def answered(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        own = [r for r in rows if r[2] < 0]
        asks = [r for r in rows if r[2] >= 0]
        if asks:
            one, two = (np.concatenate([np.frombuffer(r[k], U) for r in asks]) for k in (3, 4))
            low = np.concatenate([np.frombuffer(r[5], np.int64) for r in asks])
            order = np.lexsort((low, two, one))
            new = np.ones(len(order), bool)
            new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
            least = np.empty(len(order), np.int64)
            least[order] = low[order][new][np.cumsum(new) - 1]
            cuts = np.cumsum([len(r[5]) // 8 for r in asks])[:-1]
            own += [(0, r[1], r[2], None, None, v.tobytes(), None) for r, v in zip(asks, np.split(least, cuts))]
        if own:
            yield _packed(own)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, least = None, None, None
        for batch in batches:
            for me, start, lows, raw in zip(*(batch.column(c).to_pylist() for c in ("slice", "start", "lows", "own"))):
                if me != at:
                    if at is not None:
                        yield spans(own, least)
                    at, own, least = me, None, None
                if start < 0:  # comes first
                    own = np.frombuffer(raw, np.int64).reshape(4, -1)
                    least = np.zeros(own[3].max() + 1, np.int64)
                else:
                    v = np.frombuffer(lows, np.int64)
                    least[start : start + len(v)] = v
        if at is not None:
            yield spans(own, least)

    def spans(own: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        ids, tids, lo, _ = own[:, own[0] > least[own[3]]]  # by row and position
        cut = np.ones(len(ids), bool)
        cut[1:] = (ids[1:] != ids[:-1]) | (tids[1:] != tids[:-1]) | (lo[1:] > lo[:-1] + length) | (lo[1:] < lo[:-1])
        begin = np.flatnonzero(cut)
        last = np.append(begin[1:], len(ids)) - 1
        cols = (ids[begin], tids[begin], lo[begin], lo[last] + length) if len(ids) else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "tid", "a", "b"])

    hot = involved.where(F.exists("at", lambda x: x["hot"])).select("doc_id", "tid", "text", "at").mapInArrow(look, _PACKED)
    met = hot.repartition(partitions(spark), "part").sortWithinPartitions("part").mapInArrow(meet, _PACKED)
    return met.repartition(partitions(spark), "slice").sortWithinPartitions("slice", "start").mapInArrow(gather, "doc_id long, tid long, a long, b long")


def matched(passages: DataFrame, length: int) -> DataFrame:
    """Rows of a shard together and in the order of doc_id, to spans (doc_id, tid, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, out = None, [], []
        for batch in batches:
            for part in slices(batch, "passage"):
                w = words(part.column("passage"))
                h, cuts = w.hashes().tolist(), w.first.tolist()
                for k, row in enumerate(zip(*(part.column(c).to_pylist() for c in ("anchor", "doc_id", "tid", "lo")))):
                    if row[0] != at:
                        out += shard_spans(group, length)
                        at, group = row[0], []
                    group.append((*row[1:], h[cuts[k] : cuts[k + 1]]))
                if len(out) > 50_000:
                    yield table(out)
                    out = []
        out += shard_spans(group, length)
        if out:
            yield table(out)

    def table(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "tid", "a", "b"])

    return passages.mapInArrow(run, "doc_id long, tid long, a long, b long")


def cleaned(rows: DataFrame, with_text: bool) -> DataFrame:
    """rows (doc_id, key, text, spans) to (doc_id, key, n_removed, kept_sha256 [, kept])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                gone = np.zeros(len(w.start) + 1, np.int64)
                for first, spans in zip(w.first.tolist(), part.column("spans").to_pylist()):
                    for s in spans:
                        gone[first + s["a"]] += 1
                        gone[first + s["b"]] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                kept = list(kept_texts(w, gone))
                removed = np.concatenate([[0], np.cumsum(gone)])[w.first]
                cols = [part.column("doc_id"), part.column("key"), pa.array(np.diff(removed)), pa.array([hashlib.sha256(t).hexdigest() for t in kept])]
                cols += [pa.array([t.decode() for t in kept], pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return rows.select("doc_id", "key", "text", "spans").mapInArrow(run, "doc_id long, key string, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def removals(docs: DataFrame, length: int = LENGTH, size: int = ANCHOR, shard: int = SHARD, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, changed). rows: doc_id, key, n_words, whole_sha256, copy (a smaller doc_id has the text) of each row.
    changed: doc_id, key, n_removed, kept_sha256 [, kept] of the other texts that lose words."""
    spark = docs.sparkSession
    docs = identified(docs)
    scan = stored(scanned(docs, length, size), "dedup-scan")
    texts = stored(scan.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("text_id")), "dedup-texts")
    own = scan.join(texts.withColumnRenamed("text_id", "doc_id"), ["doc_id", "key"])
    placed = own.where("size(anchors) > 0").select("doc_id", "key", F.explode(F.arrays_zip("anchors", "begins", "windows")).alias("x"))
    placed = placed.select("doc_id", "key", F.col("x.anchors").alias("code"), F.col("x.begins").alias("begin"), F.col("x.windows").alias("windows"))
    placed = stored(placed, "dedup-anchors")
    often = placed.groupBy("code").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high")
    often = stored(often.select("code", (F.col("n") > shard).alias("hot")), "dedup-often")
    met = placed.join(often, "code")
    met = met.groupBy("doc_id", "key").agg(F.collect_list(F.struct("begin", "code", "windows", "hot")).alias("at"))  # a text's own anchors
    involved = docs.select("doc_id", "key", "text").join(met, ["doc_id", "key"]).withColumn("tid", F.xxhash64("key"))
    involved = stored(involved, "dedup-involved")
    shards = contexts(involved, length).repartition(partitions(spark), "anchor").sortWithinPartitions("anchor", "doc_id", "tid", "lo")
    spans = matched(shards, length).unionByName(hot_spans(involved, length))
    spans = spans.groupBy("doc_id", "tid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # of one text
    changed = cleaned(involved.select("doc_id", "key", "tid", "text").join(spans, ["doc_id", "tid"]), with_text).dropDuplicates(["doc_id", "key"])
    changed = stored(changed, "dedup-changed")
    discard(placed, often, involved)
    copies = texts.withColumnRenamed("key", "_key")
    rows = scan.drop("anchors", "begins", "windows").join(copies, F.col("key") == F.col("_key"), "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("text_id"), F.lit(False)))
    return rows.drop("_key", "text_id"), changed


def dedup(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    rows, changed = removals(docs, length, **how)
    out = rows.join(changed, ["doc_id", "key"], "left")
    whole = F.col("copy") & (F.col("n_words") >= length)
    return out.select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """The documents, each text that loses words as its kept words joined by one space; other texts and columns stay."""
    rows, changed = removals(docs, length, with_text=True, **how)
    gone = rows.where(F.col("copy") & (F.col("n_words") >= length)).select("doc_id", "key", F.lit("").alias("kept")).distinct()
    changed = changed.select("doc_id", "key", "kept").unionByName(gone)
    out = whole(docs, doc_id=F.col("doc_id").cast("long"), key=text_key()).join(changed, ["doc_id", "key"], "left")
    return out.select(*[F.coalesce("kept", "r.text").alias(c) if c == "text" else F.col(f"r.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT row, doc_id, k, list_aggregate(ws[k : k + 49], 'string_agg', ' ') AS w
  FROM (SELECT row, doc_id, ws, unnest(range(1, len(ws) - 48)) AS k FROM d WHERE len(ws) >= 50)),
f AS (SELECT row, k FROM (SELECT row, doc_id, k, min(doc_id) OVER (PARTITION BY w) AS low FROM s) WHERE doc_id > low),
g AS (SELECT DISTINCT row, unnest(range(k, k + 50)) AS k FROM f),
w AS (SELECT row, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d),
r AS (
  SELECT w.row, count(g.k) AS n_removed, string_agg(CASE WHEN g.k IS NULL THEN word END, ' ' ORDER BY w.k) AS kept
  FROM w LEFT JOIN g ON g.row = w.row AND g.k = w.k GROUP BY w.row)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (row)
"""
