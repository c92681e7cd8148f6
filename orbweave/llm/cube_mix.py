"""Mixing sources to target weights with cube-method balanced sampling.

A source's documents share one expected number of copies, target / size. The whole copies are certain; the fractional
rest is an inclusion probability, and a sample is drawn that balances the documents and the tokens of its source.
The flight phase moves the probabilities of three documents at a time along the null-space of their two constraints
until one of them is 0 or 1. It runs over blocks of a source, side by side. What is left fractional, two documents a block, meets
in blocks of the next level together with ten that each block holds back, until one block of each source is left.
Those twelve documents are landed by the best balanced of their 4096 outcomes.

A null source is a source of its own, sorted last. Null and empty texts have size 0. All draws come from a hash of the
doc_id and the text, so reruns agree, and rows that share a doc_id, or have none, are dealt to blocks like others;
repeated rows (equal doc_id and text) count as rows of their own and, being equal, may swap places. A text of any length
is counted whole. Empty tables give empty results. Other columns stay as they are.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.storage import stored, whole

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK = 4096
LEVELS = 4
_EPS = 1e-9


def sized(docs: DataFrame) -> DataFrame:
    """The documents with size, their number of words."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: shares of ``budget`` times all words by weight, none above ``most`` times its
    source's words; what exceeds that goes to the others by weight. With caps c and weights w the fixed point is
    min(c, level * w), and the level follows from the sources sorted by c / w. One row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    below, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(budget))
    level = (total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(rest)
    per = per.withColumn("level", level)
    # the first source, in that order, whose cap the level doesn't reach; all before it are at their caps
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(everything)["level"]
    return per.select("source", "source_size", F.coalesce(F.least("cap", level * F.col("w")), F.col("cap")).alias("target"))


HELD = 10


def flight(pi: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The probabilities after the flight phase for the constraints sum(pi) and sum(pi * size); at most two stay
    fractional."""
    x = (size / max(1.0, float(size.max(initial=1)))).tolist()
    pi, draw = pi.astype(float).tolist(), draw.tolist()
    live: list[int] = []
    for k in range(len(pi)):
        live.append(k)
        if len(live) < 3:
            continue
        a, b, c = live
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])  # orthogonal to (1, 1, 1) and to the sizes
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - pi[i]) / v if v > 0 else -pi[i] / v) for i, v in zip(live, u) if v)
        down = min((pi[i] / v if v > 0 else (pi[i] - 1) / v) for i, v in zip(live, u) if v)
        step = up if draw[k] * (up + down) < down else -down
        rest = []
        for i, v in zip(live, u):
            pi[i] += step * v
            if _EPS < pi[i] < 1 - _EPS:
                rest.append(i)
            else:
                pi[i] = float(round(pi[i]))
        live = rest
    return np.array(pi)


def landed(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """0 or 1 for each of a few documents, as near as can be to the tokens and documents that pi expects."""
    outcomes = (np.arange(1 << len(pi))[:, None] >> np.arange(len(pi))) & 1
    tokens = (outcomes @ size - pi @ size) / max(1.0, size.mean())
    cost = tokens**2 + 0.01 * (outcomes.sum(1) - pi.sum()) ** 2
    return outcomes[np.argmin(cost)].astype(float)


def _flown(pdf: pd.DataFrame, land: bool) -> pd.DataFrame:
    pdf = pdf.drop(columns="block").sort_values(["draw", "doc_id", "text_hash", "row"])
    pi, size = pdf["pi"].to_numpy(float).copy(), pdf["size"].to_numpy(float)
    fresh = np.modf(pdf["draw"].to_numpy() * 1048576.0)[0]
    settled = (pi <= _EPS) | (pi >= 1 - _EPS)
    pi[settled] = np.round(pi[settled])
    open_ = np.flatnonzero(~settled)
    fly = open_[: max(0, len(open_) - HELD)]
    pi[fly] = flight(pi[fly], size[fly], fresh[fly])
    if land:
        last = np.flatnonzero((pi > 0) & (pi < 1))
        if len(last):
            pi[last] = landed(pi[last], size[last])
    return pdf.assign(pi=pi)


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    return _flown(pdf, False)


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    return _flown(pdf, True)


_FIELDS = "source string, doc_id long, text_hash long, row long, size long, draw double, pi double"


def balanced(units: DataFrame, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """units: source, doc_id, text_hash, row, size, draw (0 to 1), pi. The same with pi 0 or 1. ``levels`` passes over blocks of
    about ``block`` units; each pass leaves at most twelve open units of a block, so levels=4 serve 10**11 units."""
    settled = None
    for level in range(levels):
        last = level == levels - 1
        if last:
            keyed = units.withColumn("block", F.lit(0).cast("long"))
        else:
            counts = units.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(block))).cast("long").alias("n"))
            counts = stored(counts.withColumnRenamed("source", "s"), f"mix-blocks-{level}")  # one row per source; Spark sees its size
            keyed = units.join(counts, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash", "row", F.lit(level)), "n")).drop("s", "n")

        keyed = keyed.select("block", *[c.split(" ")[0] for c in _FIELDS.split(", ")])
        done = stored(keyed.groupBy("source", "block").applyInPandas(_land if last else _fly, _FIELDS), f"mix-{level}")
        fixed = done.where("pi in (0.0, 1.0)")
        settled = fixed if settled is None else settled.unionByName(fixed)
        units = done.where("pi not in (0.0, 1.0)")
    return settled


def _repeated():
    """Rows that repeat a doc_id and a text; they may differ in source."""
    return Window.partitionBy("doc_id", "text_hash").orderBy("source")


def copies(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, text_hash, row, source, size, source_size, target, copies. row: which of the rows with the same doc_id and
    text, from 0."""
    base = stored(sized(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "source", "size"), "mix-sizes")
    ranked = base.withColumn("row", F.row_number().over(_repeated()).cast("long") - 1)
    goal = targets(base, weights, budget, most).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    goal = stored(goal, "mix-targets")
    units = ranked.join(goal.select(F.col("source").alias("s"), "rate"), F.col("source").eqNullSafe(F.col("s")))
    draw = F.pmod(F.xxhash64("doc_id", "text_hash", "row", F.lit("draw")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    whole = F.floor(F.col("rate") + 1e-12)
    units = units.select("source", "doc_id", "text_hash", "row", "size", draw.alias("draw"), F.greatest(F.lit(0.0), F.col("rate") - whole).alias("pi"))
    chosen = balanced(stored(units, "mix-units"))
    goal = goal.withColumnRenamed("source", "s")
    return chosen.join(goal, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "text_hash", "row", "source", "size", "source_size", "target", (whole + F.col("pi")).cast("int").alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents, each as often as the mix takes it."""
    chosen = copies(docs, **how).where("copies > 0").select("doc_id", "text_hash", "row", "copies")
    rows = whole(docs, doc_id=F.col("doc_id"), text_hash=F.xxhash64("text"), source=F.col("source"))
    rows = rows.withColumn("row", F.row_number().over(_repeated()).cast("long") - 1)
    rows = rows.select("r", *[F.col(c).alias(f"own_{c}") for c in ("doc_id", "text_hash", "row")])
    same = F.col("own_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("own_text_hash") == F.col("text_hash")) & (F.col("own_row") == F.col("row"))
    return rows.join(chosen, same).select("r", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
